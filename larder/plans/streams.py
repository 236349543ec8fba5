"""Queries: Structured Streaming over the event and part files, run until the files are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import streaming as op
from larder.operators import filters
from larder.operators import upserts as up
from larder.plans.registry import query, table
from larder.plans.sources import alias_learning, scratch


def stream(spark, d, name="events", watermark="40 days"):
    schema = table(spark, d, name).schema
    return op.event_stream(spark, d, f"{name}.parquet", schema, watermark)


@query("src_incremental_resume", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1 UNION ALL SELECT 'all batches', count(*), round(sum(value), 4) FROM events")
def src_incremental_resume(spark, d):
    """Three runs on one checkpoint while files come in, the last one without any; the counters of all batches beside the rows."""
    files, path, progress, checkpoint = (scratch(spark, f"resume-{x}") for x in ("in", "out", "progress", "checkpoint"))
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    for part in (0, 1, None):
        if part is not None:
            events.filter(F.col("event_id") % 2 == part).repartition(2).write.mode("append").parquet(files)
        arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(files)
        op.ingest_counted(arriving, path, progress, checkpoint, {"n": F.count(F.lit(1)), "total": F.sum("value")})
    rows = spark.read.schema("event_id long, event_type string, value double").parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    counted = spark.read.schema("n long, total double").parquet(progress).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
    return rows.unionByName(counted.select(F.lit("all batches").alias("event_type"), "n", "total"))


@query(
    "stm_rate_limit",
    """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts::TIMESTAMP) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_id, n, true AS admitted, [t] AS times FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, len(list_filter(s.times, lambda x: x > e.t - 21600)) < 2, CASE WHEN len(list_filter(s.times, lambda x: x > e.t - 21600)) < 2 THEN list_append(list_filter(s.times, lambda x: x > e.t - 21600), e.t) ELSE list_filter(s.times, lambda x: x > e.t - 21600) END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, event_id, admitted FROM s""",
)
def stm_rate_limit(spark, d):
    """2 events per user in 6 hours, as a stateful stream."""
    path = scratch(spark, "rate")
    with op.state_store(spark):
        op.run_available(op.rate_limit_stream(stream(spark, d), 2, 6 * 3600), path, scratch(spark, "rate-checkpoint"))
    return spark.read.schema("user_id long, event_id long, admitted boolean").parquet(path)


@query("stm_status_counts", "SELECT event_type AS status, count(*) AS count FROM events GROUP BY 1")
def stm_status_counts(spark, d):
    path = scratch(spark, "status")
    op.run_batches(op.status_counts(stream(spark, d), F.col("event_type")), lambda df, _: df.write.mode("overwrite").parquet(path), scratch(spark, "status-checkpoint"), "complete")
    return spark.read.schema("status string, count long").parquet(path)


@query("stm_dedup_shown", "SELECT DISTINCT user_id, event_id % 10 AS url FROM events")
def stm_dedup_shown(spark, d):
    path = scratch(spark, "shown")
    shown = stream(spark, d).select("user_id", (F.col("event_id") % 10).alias("url"), "ts")
    op.run_available(op.dedup_shown(shown, ["user_id", "url"]).select("user_id", "url"), path, scratch(spark, "shown-checkpoint"))
    return spark.read.schema("user_id long, url long").parquet(path)


@query(
    "stm_alias_upsert",
    """
WITH c AS (SELECT 'a' || (p_partkey % 400)::VARCHAR AS alias_text, min(p_partkey) AS ingredient_id FROM part WHERE p_partkey % 400 < 200 GROUP BY 1), s AS (SELECT 'a' || (event_id % 400)::VARCHAR AS alias_text, count(*) AS n FROM events GROUP BY 1)
SELECT alias_text, CASE WHEN ingredient_id IS NULL THEN 0 ELSE 3 END + coalesce(n, 0) AS usage_count FROM c FULL JOIN s USING (alias_text)""",
)
def stm_alias_upsert(spark, d):
    current, _ = alias_learning(spark, d)
    root = scratch(spark, "alias")
    events = stream(spark, d).select(F.concat(F.lit("a"), (F.col("event_id") % 400).cast("string")).alias("alias_text"), F.col("user_id").alias("ingredient_id"), F.lit(0.5).alias("confidence"), "ts", F.lit(1).cast("long").alias("n"))
    return op.upsert_versions(events, root, f"{root}-checkpoint", up.learn_aliases, current).select("alias_text", "usage_count")


@query("stm_tier_ingest", "SELECT p_partkey, CASE WHEN p_size >= 30 THEN 'tier1' WHEN p_size >= 15 THEN 'tier2' ELSE 'tier3' END AS tier FROM part WHERE trim(p_name) <> '' AND p_retailprice BETWEEN 0 AND 980")
def stm_tier_ingest(spark, d):
    path = scratch(spark, "tier")
    raw = spark.readStream.schema(table(spark, d, "part").schema).option("pathGlobFilter", "part.parquet").parquet(d)
    good = filters.numeric_range(filters.required_fields(raw, ["p_name"]), {"p_retailprice": (0, 980)})
    tier = F.when(F.col("p_size") >= 30, "tier1").when(F.col("p_size") >= 15, "tier2").otherwise("tier3")
    out = good.select("p_partkey", tier.alias("tier"))
    out.writeStream.format("parquet").partitionBy("tier").option("path", path).option("checkpointLocation", scratch(spark, "tier-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("p_partkey long, tier string").parquet(path)
