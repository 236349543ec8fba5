"""Queries: ranking, windows, de-duplication and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions import domain
from larder.operators import ranking as op
from larder.plans.filters import DOMAIN_SQL, records
from larder.plans.registry import query, table
from larder.plans.scoring import SEARCH_SQL

CAND_SQL = f"(SELECT page_id % 7 AS query_id, page_id AS pos, page_id, url, {DOMAIN_SQL} AS domain, {DOMAIN_SQL} LIKE 'blog.%' AS trusted FROM pages)"
PRIORITY = ["blog.theres.example.com", "thther.example.org", "therea.example.net", "blog.theres.example.com"]
PRIORITY_SQL = "(SELECT site AS domain, min(place) AS place FROM (VALUES " + ", ".join(f"('{s}', {k})" for k, s in enumerate(PRIORITY)) + ") AS t(site, place) GROUP BY 1)"


def candidates(spark, d):
    name = domain("url")
    return table(spark, d, "pages").select((F.col("page_id") % 7).alias("query_id"), F.col("page_id").alias("pos"), "page_id", "url", name.alias("domain"), name.like("blog.%").alias("trusted"))


@query("win_priority_rank", f"SELECT * FROM (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(place, 1073741824), pos)::INTEGER AS rank FROM {CAND_SQL} LEFT JOIN {PRIORITY_SQL} USING (domain)) WHERE rank <= 20")
def win_priority_rank(spark, d):
    listed = spark.createDataFrame([(s, k) for k, s in enumerate(PRIORITY)], "site string, place int")
    return op.priority_rank(candidates(spark, d), listed, "query_id", "domain", "pos", 20).select("query_id", "page_id", "rank")


@query("win_three_band_order", f"SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN trusted THEN 0 WHEN contains(url, 'html') THEN 1 ELSE 2 END, pos)::INTEGER AS rank FROM {CAND_SQL}")
def win_three_band_order(spark, d):
    return op.band_rank(candidates(spark, d), "query_id", [F.col("trusted"), F.col("url").contains("html")], "pos").select("query_id", "page_id", "rank")


@query(
    "win_top5_promote",
    f"WITH i AS (SELECT *, row_number() OVER (PARTITION BY query_id, trusted ORDER BY pos) AS k FROM {CAND_SQL}) SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN trusted AND k <= 5 THEN 0 WHEN NOT trusted THEN 1 ELSE 2 END, pos)::INTEGER AS rank FROM i",
)
def win_top5_promote(spark, d):
    return op.promote_top(candidates(spark, d), "query_id", F.col("trusted"), "pos").select("query_id", "page_id", "rank")


@query("win_domain_quota", f"SELECT query_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY pos) AS k FROM {CAND_SQL}) WHERE k <= 2")
def win_domain_quota(spark, d):
    return op.domain_quota(candidates(spark, d), "query_id", "domain", "pos").select("query_id", "page_id")


@query("win_domain_quota_existing", f"WITH u AS (SELECT query_id, domain, count(*) AS used FROM {CAND_SQL} WHERE page_id % 4 = 0 GROUP BY 1, 2) SELECT query_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY pos) AS k FROM {CAND_SQL} WHERE page_id % 4 > 0) LEFT JOIN u USING (query_id, domain) WHERE k + coalesce(used, 0) <= 2")
def win_domain_quota_existing(spark, d):
    c = candidates(spark, d)
    used = c.filter("page_id % 4 = 0").groupBy("query_id", "domain").agg(F.count(F.lit(1)).alias("used"))
    return op.domain_quota(c.filter("page_id % 4 > 0"), "query_id", "domain", "pos", 2, used).select("query_id", "page_id")


@query(
    "win_interleaved_batches",
    f"""
WITH RECURSIVE c AS (SELECT query_id, coalesce(domain, '') AS d, count(*)::INTEGER AS n, bool_or(trusted) AS t FROM {CAND_SQL} GROUP BY 1, 2),
q AS (SELECT query_id, list(d ORDER BY NOT t, d) AS ds, list(n ORDER BY NOT t, d) AS ns FROM c GROUP BY 1),
s AS (SELECT query_id, ns AS rem, 1 AS i, 1 AS batch, 10 AS space, 0 AS took, 0 AS pick, 0 AS b FROM q
  UNION ALL SELECT query_id, list_transform(rem, lambda x, k: CASE WHEN k = i THEN x - least(2, x, space) ELSE x END), CASE WHEN i = len(rem) OR space = least(2, rem[i], space) THEN 1 ELSE i + 1 END,
    CASE WHEN i = len(rem) OR space = least(2, rem[i], space) THEN batch + 1 ELSE batch END, CASE WHEN i = len(rem) OR space = least(2, rem[i], space) THEN 10 ELSE space - least(2, rem[i], space) END, least(2, rem[i], space), i, batch
  FROM s WHERE list_sum(rem) > 0),
p AS (SELECT query_id, ds[pick] AS d, b, took, sum(took) OVER (PARTITION BY query_id, pick ORDER BY b) AS upto FROM s JOIN q USING (query_id) WHERE took > 0),
r AS (SELECT query_id, page_id, domain, row_number() OVER (PARTITION BY query_id, coalesce(domain, '') ORDER BY pos) AS k FROM {CAND_SQL})
SELECT r.query_id, r.page_id, r.domain, p.b::INTEGER AS batch FROM r JOIN p ON p.query_id = r.query_id AND p.d = coalesce(r.domain, '') AND r.k <= upto AND r.k > upto - took""",
)
def win_interleaved_batches(spark, d):
    return op.interleaved_batches(candidates(spark, d), "query_id", "domain", "trusted", "pos").select("query_id", "page_id", "domain", "batch")


@query("win_dedup_keep_first", "SELECT source, arg_min(doc_id, n_chars * 1000000 + doc_id) AS doc_id FROM documents WHERE trim(source) <> '' GROUP BY source")
def win_dedup_keep_first(spark, d):
    return op.keep_first(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], ["n_chars", "doc_id"], "source").select("source", "doc_id")


@query("win_section_fill", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def win_section_fill(spark, d):
    return op.section_fill(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", "text").select("conv_id", "turn", "section")


@query(
    "win_early_exit_cutoff",
    """
WITH c AS (SELECT source, doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents LEFT JOIN labels USING (doc_id)),
m AS (SELECT source, doc_id, quality IS NOT NULL AS ok, quality IS NOT NULL AND doc_id % 4 > 0 AS passed, coalesce(quality = 1, false) AND doc_id % 4 > 0 AS good FROM c WHERE p <= 15 AND doc_id % 11 > 0),
r AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (ok) OVER w AS n_ok, count(*) FILTER (good) OVER w AS n_good FROM m WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT source, min(n) AS stop FROM r WHERE (good AND n_good >= 3 AND (n_good >= 5 OR (n >= 8 AND n_ok >= 0.6 * n AND n_good >= 0.4 * greatest(n_ok, 1)))) OR (passed AND n >= 10 AND n_ok < 0.3 * n) GROUP BY 1)
SELECT r.source, doc_id, n FROM r LEFT JOIN s ON s.source IS NOT DISTINCT FROM r.source WHERE n <= coalesce(stop, 15)""",
)
def win_early_exit_cutoff(spark, d):
    quality, k = F.col("quality"), F.col("doc_id")
    return op.early_exit(records(spark, d), "source", "doc_id", quality.isNotNull(), k % 4 > 0, quality == 1, tried=k % 11 > 0).select("source", "doc_id", "n")


@query(
    "win_batch_cutoff",
    f"""
WITH c AS (SELECT *, (page_id // 7) // 5 AS batch FROM {CAND_SQL}), f AS (SELECT query_id, batch, count(*) AS d FROM (SELECT query_id, domain, min(batch) AS batch FROM c GROUP BY 1, 2) GROUP BY 1, 2),
p AS (SELECT query_id, batch, count(*) AS n FROM c GROUP BY 1, 2), r AS (SELECT query_id, batch, sum(n) OVER w AS cn, sum(coalesce(d, 0)) OVER w AS cd FROM p LEFT JOIN f USING (query_id, batch) WINDOW w AS (PARTITION BY query_id ORDER BY batch)),
s AS (SELECT query_id, min(batch) AS stop FROM r WHERE cn >= 12 AND cd >= 3 GROUP BY 1)
SELECT query_id, page_id, batch FROM c LEFT JOIN s USING (query_id) WHERE stop IS NULL OR batch <= stop""",
)
def win_batch_cutoff(spark, d):
    c = candidates(spark, d).withColumn("batch", F.expr("(page_id div 7) div 5"))
    return op.batch_cutoff(c, "query_id", "batch", "domain", 12, 3).select("query_id", "page_id", "batch")


MATCH_SQL = "(SELECT o_custkey AS query_id, o_orderkey, o_totalprice < 150000 AND o_orderstatus = 'F' AS exact, (CASE WHEN o_totalprice < 150000 THEN 100.0 ELSE round(15000000 / o_totalprice, 1) END * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE AS pct FROM orders)"


def matches(spark, d):
    o = table(spark, d, "orders")
    price, f = F.col("o_totalprice"), F.col("o_orderstatus") == "F"
    pct = F.when(f, F.when(price < 150000, 100.0).otherwise(F.round(15000000 / price, 1))).otherwise(0.0)
    return o.select(F.col("o_custkey").alias("query_id"), "o_orderkey", ((price < 150000) & f).alias("exact"), pct.alias("pct"))


@query(
    "win_exact_then_closest",
    f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN exact THEN 0 ELSE 1 END, pct DESC, o_orderkey)::INTEGER AS rank FROM {MATCH_SQL} WHERE exact OR pct > 0) SELECT query_id, o_orderkey, rank, NOT exact AS closest_match FROM r WHERE exact OR rank <= 3",
)
def win_exact_then_closest(spark, d):
    return op.exact_then_closest(matches(spark, d), "query_id", "o_orderkey", "exact", "pct", 3).select("query_id", "o_orderkey", "rank", "closest_match")


@query("win_topk_closest", f"SELECT query_id, o_orderkey, pct FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pct DESC, o_orderkey) AS k FROM {MATCH_SQL} WHERE pct > 0) WHERE k <= 3")
def win_topk_closest(spark, d):
    return op.closest(matches(spark, d), "query_id", "o_orderkey", "pct").select("query_id", "o_orderkey", "pct")


@query("win_recent_n", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def win_recent_n(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "c_name", "o_totalprice")


@query(
    "win_score_trend",
    """WITH e AS (SELECT user_id * 10 + event_id % 37 AS session, floor(value / 20) AS score, ts, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS k FROM e),
t AS (SELECT session, max(score) FILTER (k = 1) AS a, max(score) FILTER (k = 2) AS b FROM r GROUP BY 1) SELECT session, CASE WHEN b IS NULL THEN 'insufficient_data' WHEN a > b THEN 'improving' WHEN a < b THEN 'declining' ELSE 'stable' END AS trend FROM t""",
)
def win_score_trend(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") * 10 + F.col("event_id") % 37).alias("session"), F.floor(F.col("value") / 20).alias("score"), "ts", "event_id")
    return op.score_trend(e, "session", ["ts", "event_id"], "score")


@query("win_save_once", "WITH s AS (SELECT user_id, event_id % 50 AS url, event_id, row_number() OVER (PARTITION BY user_id, event_id % 50 ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase' AND event_id % 9 < 5) SELECT user_id, url, event_id FROM s WHERE k = 1")
def win_save_once(spark, d):
    batch = spark.range(5).select(F.col("id").alias("item"))
    saves = table(spark, d, "events").filter("event_type = 'purchase'").withColumns({"item": F.col("event_id") % 9, "url": F.col("event_id") % 50}).join(F.broadcast(batch), "item", "left_semi")  # five items
    return op.keep_first(saves.select("user_id", "url", "event_id", "ts"), ["user_id", "url"], ["ts", "event_id"]).select("user_id", "url", "event_id")


@query("win_search_history_tail", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10")
def win_search_history_tail(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").select("user_id", "event_id", "ts").withColumn("k", k).filter("k <= 10").select("user_id", "event_id")


@query("win_position_number", f"SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY domain, pos)::INTEGER AS position FROM {CAND_SQL}")
def win_position_number(spark, d):
    return candidates(spark, d).select("query_id", "page_id", F.row_number().over(Window.partitionBy("query_id").orderBy("domain", "pos")).alias("position"))


@query("set_union_dedup", f"WITH c AS (SELECT domain AS url, page_id, page_id % 2 AS half FROM {CAND_SQL}) SELECT url, page_id FROM c WHERE half = 0 UNION ALL SELECT url, min(page_id) FROM c WHERE half = 1 AND url <> '' AND url NOT IN (SELECT url FROM c WHERE half = 0) GROUP BY 1")
def set_union_dedup(spark, d):
    c = candidates(spark, d).select(F.col("domain").alias("url"), "page_id")
    existing, new = c.filter("page_id % 2 = 0"), c.filter("page_id % 2 = 1")
    fresh = op.keep_first(new, ["url"], ["page_id"], "url").join(existing, "url", "left_anti")
    return existing.unionByName(fresh.select("url", "page_id"))


ORDERED_SQL = f"(SELECT domain, arg_min(page_id, (band, pos)) AS page_id, ['priority', 'general', 'fallback'][min(band) + 1] AS origin FROM (SELECT *, CASE WHEN trusted THEN 0 ELSE 1 END AS band FROM {CAND_SQL}) GROUP BY 1)"


@query("set_union_ordered", f"SELECT domain, page_id, origin FROM {ORDERED_SQL}")
def set_union_ordered(spark, d):
    c = candidates(spark, d).select("domain", "page_id", "pos", "trusted")
    return op.union_ordered([("priority", c.filter("trusted")), ("general", c)], ["domain"], "pos", "domain").select("domain", "page_id", "origin")


@query("set_multi_strategy", f"WITH u AS (SELECT *, 0 AS band FROM {CAND_SQL} WHERE page_id % 3 = 1 UNION ALL SELECT *, 1 FROM {CAND_SQL} WHERE page_id % 2 = 0 UNION ALL SELECT *, 2 FROM {CAND_SQL} WHERE trusted) SELECT domain, arg_min(page_id, (band, pos)) AS page_id, ['a', 'b', 'c'][min(band) + 1] AS origin FROM u WHERE domain <> '' GROUP BY 1")
def set_multi_strategy(spark, d):
    c = candidates(spark, d).select("domain", "page_id", "pos", "trusted")
    return op.union_ordered([("a", c.filter("page_id % 3 = 1")), ("b", c.filter("page_id % 2 = 0")), ("c", c.filter("trusted"))], ["domain"], "pos", "domain").select("domain", "page_id", "origin")


@query("set_ordered_distinct", "WITH w AS (SELECT doc_id, list_concat([lang, source], string_split(lower(text), ' ')) AS l FROM documents) SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(l), lambda x: list_position(l, x))), lambda i: l[i]), ' ') AS terms FROM w")
def set_ordered_distinct(spark, d):
    terms = F.array_distinct(F.concat(F.array("lang", "source"), F.split(F.lower("text"), " ")))
    return table(spark, d, "documents").select("doc_id", F.array_join(terms, " ").alias("terms"))


@query("set_track_once", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS seen FROM events GROUP BY 1")
def set_track_once(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("seen"))
