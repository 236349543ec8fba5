"""Queries: sources, sinks and upserts. Files go to scratch folders; each query returns what it reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import sources as op
from larder.operators import upserts as up
from larder.plans.filters import records
from larder.plans.lookups import ALIAS_SQL, aliases
from larder.plans.registry import query, table
from larder.plans.scoring import TIERED_SQL, tiered
from larder.sources.scratch import drop_scratch, scratch  # noqa: F401  (other modules get both here)


def parts_as_tsv(spark, d, bad: bool = False) -> tuple[str, list[str]]:
    path = scratch(spark, "tsv")
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("product_name"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("brands"), F.col("p_size").cast("string").alias("size"), F.col("p_retailprice").cast("string").alias("price"))
    if bad:
        p = p.withColumn("size", F.when(F.col("code").cast("long") % 50 == 7, "many").otherwise(F.col("size")))
    p.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    return path, p.columns


@query("src_tsv_projected", "SELECT p_partkey::VARCHAR AS code, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS brands FROM part")
def src_tsv_projected(spark, d):
    path, header = parts_as_tsv(spark, d)
    return op.tsv_projected(spark, path, header, ["code", "brands"])


@query("src_tsv_bad_lines", "SELECT count(*) FILTER (p_partkey % 50 <> 7) AS good, count(*) FILTER (p_partkey % 50 = 7) AS bad, sum(p_size) FILTER (p_partkey % 50 <> 7)::BIGINT AS total_size FROM part")
def src_tsv_bad_lines(spark, d):
    path, header = parts_as_tsv(spark, d, True)
    rows = op.tsv_bad_lines(spark, path, header, {"size": "int", "price": "double"})
    ok = F.col("bad_line").isNull()
    return rows.agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"), F.sum(F.when(ok, F.col("size"))).alias("total_size"))


@query("src_profile_columns", "SELECT 'quality' AS \"column\", count(quality) AS non_null, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', count(toxic), count(*) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'text', count(*) FILTER (trim(text) <> ''), count(*) FROM documents")
def src_profile_columns(spark, d):
    return op.profile_columns(records(spark, d), "quality|tox|text")


@query("snk_partition_by_tier", f"SELECT doc_id, completeness, quality_tier FROM {TIERED_SQL}")
def snk_partition_by_tier(spark, d):
    path = scratch(spark, "tiers")
    op.write_tiers(tiered(spark, d).select("doc_id", "completeness", "quality_tier"), path, "quality_tier")
    return spark.read.schema("doc_id long, completeness double, quality_tier string").parquet(path)


@query("snk_table_append", f"SELECT quality_tier, count(*) * 2 AS n FROM {TIERED_SQL} GROUP BY 1")
def snk_table_append(spark, d):
    path, rows = scratch(spark, "append"), tiered(spark, d).select("doc_id", "quality_tier")
    for _ in range(2):
        op.append_table(rows, path)
    return spark.read.parquet(path).groupBy("quality_tier").agg(F.count(F.lit(1)).alias("n"))


@query("snk_table_truncate_load", f"SELECT (SELECT count(*) FROM {TIERED_SQL}) AS n_before, count(*) AS n_after FROM {TIERED_SQL} WHERE quality_tier <> 'rejected'")
def snk_table_truncate_load(spark, d):
    path, rows = scratch(spark, "load"), tiered(spark, d).select("doc_id", "quality_tier")
    op.append_table(rows, path)
    old = op.truncate_load(rows.filter("quality_tier <> 'rejected'"), path)
    return spark.read.parquet(path).agg(F.lit(old).cast("long").alias("n_before"), F.count(F.lit(1)).alias("n_after"))


@query(
    "snk_upsert_by_key",
    "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 2 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, 'new ' || c_custkey::VARCHAR, c_acctbal FROM customer WHERE c_custkey % 7 = 0",
)
def snk_upsert_by_key(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = c.filter("c_custkey % 3 = 0")
    delta = changed.withColumns({"c_acctbal": F.col("c_acctbal") + 1, "v": F.lit(1)}).unionByName(changed.withColumns({"c_acctbal": F.col("c_acctbal") + 2, "v": F.lit(2)}))
    fresh = c.filter("c_custkey % 7 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.concat(F.lit("new "), F.col("c_custkey").cast("string")).alias("c_name"), "c_acctbal", F.lit(1).alias("v"))
    path, key = scratch(spark, "customers"), F.col("c_custkey")
    op.write_buckets(c, path, key, 16)
    op.upsert_buckets(path, delta.unionByName(fresh), key, 16, lambda current, more: op.upsert_by_key(current, more, "c_custkey", "v"))
    return spark.read.parquet(path).drop(op.BUCKET)


def recipe_documents(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    recipes = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return op.nested_documents(recipes, lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_linenumber", "l_partkey"])


@query(
    "snk_nested_json",
    """
WITH g AS (SELECT l_orderkey, string_agg('{"l_linenumber":' || l_linenumber::VARCHAR || ',"l_partkey":' || l_partkey::VARCHAR || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS l FROM lineitem GROUP BY 1)
SELECT o_orderkey, '{"o_orderkey":' || o_orderkey::VARCHAR || ',"o_orderpriority":"' || o_orderpriority || '","ingredients":[' || coalesce(l, '') || ']}' AS document FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""",
)
def snk_nested_json(spark, d):
    return recipe_documents(spark, d)


@query(
    "src_nested_json_explode",
    "SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INTEGER AS pos, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT o_orderkey, o_orderpriority, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def src_nested_json_explode(spark, d):
    path = scratch(spark, "json")
    recipe_documents(spark, d).select("document").write.text(path)
    read = spark.read.text(path).withColumnRenamed("value", "document")
    out = op.explode_documents(read, "o_orderkey long, o_orderpriority string, ingredients array<struct<l_linenumber:int,l_partkey:long>>", "ingredients")
    return out.select("o_orderkey", "o_orderpriority", "pos", F.col("line.l_partkey").alias("l_partkey"))


LEARN_SQL = "SELECT event_id % 400 AS k, user_id AS ingredient_id, ts FROM events"


@query(
    "ups_alias_learn",
    f"""
WITH c AS (SELECT 'a' || (p_partkey % 400)::VARCHAR AS alias_text, min(p_partkey) AS ingredient_id, 3::BIGINT AS usage_count FROM part WHERE p_partkey % 400 < 200 GROUP BY 1),
s AS (SELECT 'a' || k::VARCHAR AS alias_text, count(*) AS n, arg_min(ingredient_id, (ts, ingredient_id)) AS first FROM ({LEARN_SQL}) GROUP BY 1)
SELECT alias_text, coalesce(ingredient_id, first) AS ingredient_id, coalesce(usage_count, 0) + coalesce(n, 0) AS usage_count FROM c FULL JOIN s USING (alias_text)""",
)
def ups_alias_learn(spark, d):
    current, events = alias_learning(spark, d)
    path, key = scratch(spark, "aliases"), F.lower("alias_text")
    op.write_buckets(current.withColumn("alias_text", key), path, key, 16)
    op.upsert_buckets(path, events, key, 16, up.learn_aliases)
    return spark.read.parquet(path).select("alias_text", "ingredient_id", "usage_count")


def alias_learning(spark, d):
    text = lambda c: F.concat(F.lit("a"), (c % 400).cast("string"))
    current = table(spark, d, "part").filter("p_partkey % 400 < 200").groupBy(text(F.col("p_partkey")).alias("alias_text")).agg(F.min("p_partkey").alias("ingredient_id"))
    current = current.withColumns({"confidence": F.lit(0.9), "usage_count": F.lit(3).cast("long"), "last_used": F.lit(None).cast("timestamp")})
    events = table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.upper(text(F.col("event_id")))).otherwise(text(F.col("event_id"))).alias("alias_text"), F.col("user_id").alias("ingredient_id"), F.lit(0.5).alias("confidence"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("n"))
    return current, events


@query("ups_alias_touch", f"SELECT a.alias_text, usage_count + CASE WHEN status = 'active' THEN coalesce(n, 0) ELSE 0 END AS usage_count FROM {ALIAS_SQL} a LEFT JOIN (SELECT 'alias ' || l_suppkey::VARCHAR || '-' || l_linenumber::VARCHAR AS alias_text, count(*) AS n FROM lineitem GROUP BY 1) USING (alias_text)")
def ups_alias_touch(spark, d):
    lookups = table(spark, d, "lineitem").select(F.concat(F.lit("alias "), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("alias_text"))
    return up.touch_aliases(aliases(spark, d).withColumn("alias_text", F.lower("alias_text")), lookups).select("alias_text", "usage_count")


@query("ups_job_status", "SELECT event_id // 4 AS job, arg_max(event_type, (ts, event_id)) AS status, substring(arg_max(repeat(props, 2), (ts, event_id)), 1, 12) AS error FROM events GROUP BY 1")
def ups_job_status(spark, d):
    e = table(spark, d, "events").select(F.expr("event_id div 4").alias("job"), "ts", "event_id", F.col("event_type").alias("status"), F.repeat("props", F.lit(2)).alias("error"))
    return up.job_states(e, 12).select("job", "status", "error")
