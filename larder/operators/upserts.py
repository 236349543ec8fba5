"""Table maintenance: alias learning and job states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def learn_aliases(current: DataFrame, events: DataFrame) -> DataFrame:
    """Known aliases gain usage and a later last_used, keeping ingredient and confidence; new ones come in with theirs. Alias texts are
    compared and kept in lower case.

    current: alias_text, ingredient_id, confidence, usage_count, last_used. events: alias_text, ingredient_id, confidence, ts, n.
    """
    current = current.withColumn("alias_text", F.lower("alias_text"))
    seen = events.withColumn("alias_text", F.lower("alias_text")).groupBy("alias_text").agg(F.sum("n").alias("_n"), F.max("ts").alias("_ts"), F.min_by(F.struct("ingredient_id", "confidence"), F.struct("ts", "ingredient_id")).alias("_f"))
    joined = current.join(seen, "alias_text", "full_outer")
    return joined.select(
        "alias_text",
        F.coalesce("ingredient_id", "_f.ingredient_id").alias("ingredient_id"),
        F.coalesce("confidence", "_f.confidence").alias("confidence"),
        (F.coalesce("usage_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("usage_count"),
        F.greatest("last_used", "_ts").alias("last_used"),
    )


def touch_aliases(current: DataFrame, lookups: DataFrame) -> DataFrame:
    """Each lookup of an active alias adds one use."""
    n = lookups.groupBy("alias_text").agg(F.count(F.lit(1)).alias("_n"))
    used = F.when(F.col("status") == "active", F.coalesce("_n", F.lit(0))).otherwise(0)
    return current.join(n, "alias_text", "left").withColumn("usage_count", F.col("usage_count") + used).drop("_n")


def job_states(events: DataFrame, limit: int = 500) -> DataFrame:
    """The latest status of each job, its error text cut to `limit`. events: job, ts, event_id, status, error."""
    last = events.groupBy("job").agg(F.max_by(F.struct("status", "error", "ts"), F.struct("ts", "event_id")).alias("s"))
    return last.select("job", "s.status", F.substring("s.error", 1, limit).alias("error"), "s.ts")
