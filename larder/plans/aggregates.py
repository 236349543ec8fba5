"""Queries: aggregations and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions import domain, share
from larder.operators import aggregates as op
from larder.plans.filters import DOMAIN_SQL, records
from larder.plans.lookups import ALIAS_SQL, UNIT_SQL, aliases, ingredients, line_unit, part_macros
from larder.plans.registry import query, table
from larder.plans.scoring import SEARCH_SQL, TIERED_SQL, searches, tiered


@query("agg_multivalue_counts", "WITH v AS (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) SELECT value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 4)::DOUBLE AS pct FROM v GROUP BY 1 HAVING count(*) >= 10 ORDER BY 2 DESC, 1 LIMIT 12")
def agg_multivalue_counts(spark, d):
    return op.multivalue_counts(table(spark, d, "part"), "p_name", "[ ,|;]", 10, 12)


@query(
    "agg_scan_funnel",
    """
SELECT count(*) AS n_rows, count(*) FILTER (lang = 'en') AS n_matching, round(100.0 * count(*) FILTER (lang = 'en') / count(*), 4)::DOUBLE AS matching_pct,
  count(*) FILTER (lang = 'en' AND quality IS NULL) AS empty_quality, round(100.0 * count(*) FILTER (lang = 'en' AND quality IS NULL) / count(*) FILTER (lang = 'en'), 4)::DOUBLE AS empty_quality_pct FROM documents LEFT JOIN labels USING (doc_id)""",
)
def agg_scan_funnel(spark, d):
    return op.scan_funnel(records(spark, d), F.col("lang") == "en", {"quality": F.col("quality").isNull()})


@query("agg_tier_counts", f"SELECT quality_tier, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS rate FROM {TIERED_SQL} GROUP BY 1")
def agg_tier_counts(spark, d):
    return op.value_shares(tiered(spark, d), "quality_tier")


@query(
    "agg_stage_conversion",
    """
WITH b AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS batch, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS candidates, count(*) FILTER (o_totalprice > 100000 AND o_orderstatus = 'F') AS passed FROM orders GROUP BY 1),
c AS (SELECT *, sum(n) OVER w AS cum_n, sum(candidates) OVER w AS cum_candidates, sum(passed) OVER w AS cum_passed FROM b WINDOW w AS (ORDER BY batch))
SELECT batch::INTEGER AS batch, n, candidates, passed, cum_n::BIGINT AS cum_n, cum_candidates::BIGINT AS cum_candidates, cum_passed::BIGINT AS cum_passed,
  round(passed::DOUBLE / nullif(candidates, 0), 6) AS pass_rate, round(cum_passed::DOUBLE / nullif(cum_candidates, 0), 6) AS cum_pass_rate FROM c""",
)
def agg_stage_conversion(spark, d):
    return op.stage_conversion(table(spark, d, "orders"), F.year("o_orderdate") * 100 + F.month("o_orderdate"), F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F")


#: Every seventh line has no unit, every eleventh no quantity.
LINKED_U, LINKED_Q = "CASE WHEN l_suppkey % 7 > 0 THEN {u} END", "CASE WHEN l_partkey % 11 = 0 THEN '' WHEN l_partkey % 13 = 0 THEN concat(cast(cast(l_quantity as int) as {s}), '.5') ELSE cast(cast(l_quantity as int) as {s}) END"


@query(
    "agg_meta_ingredient",
    f"""
WITH l AS (SELECT l_orderkey, p_name, {LINKED_Q.format(s='VARCHAR')} AS q, {LINKED_U.format(u=UNIT_SQL)} AS u FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT l_orderkey, p_name, sum(nullif(q, '')::DOUBLE) FILTER (u IS NOT NULL) AS q, count(DISTINCT u) FILTER (q <> '') AS units, min(u) FILTER (q <> '') AS u, count(*) AS n_lines FROM l GROUP BY 1, 2)
SELECT l_orderkey, p_name, CASE WHEN units <> 1 THEN '' WHEN q = floor(q) THEN q::BIGINT::VARCHAR ELSE q::VARCHAR END AS quantity, CASE WHEN units = 1 THEN u ELSE '' END AS unit, n_lines FROM g""",
)
def agg_meta_ingredient(spark, d):
    unit = F.when(F.col("l_suppkey") % 7 > 0, line_unit())
    lines = table(spark, d, "lineitem").withColumns({"u": unit, "q": F.expr(LINKED_Q.format(s="string"))}).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return op.merge_lines(lines, ["l_orderkey", "p_name"], "q", "u")


@query("agg_alias_top_ingredients", f"SELECT ingredient_id, count(*) AS n_aliases, round(avg(confidence), 6) AS mean_confidence, sum(usage_count)::BIGINT AS total_usage FROM {ALIAS_SQL} GROUP BY 1 ORDER BY 2 DESC, 4 DESC, 1 LIMIT 20")
def agg_alias_top_ingredients(spark, d):
    g = aliases(spark, d).join(ingredients(spark, d).select("ingredient_id"), "ingredient_id").groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("n_aliases"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.sum("usage_count").alias("total_usage"))
    return g.orderBy(F.desc("n_aliases"), F.desc("total_usage"), "ingredient_id").limit(20)


#: Two nutrients of a saved meal, named and measured as texts.
NUTRIENT = "(CASE event_id % 5 WHEN 0 THEN 'Calories' WHEN 1 THEN 'Protein' WHEN 2 THEN 'Saturated Fat' WHEN 3 THEN 'Net carbs' ELSE 'Fibre' END)"
AMOUNT = "(CASE WHEN event_id % 17 = 0 THEN 'none' WHEN event_id % 2 = 0 THEN concat(cast(event_id % 400 as {s}), ' kcal') ELSE concat('~', cast(event_id % 90 as {s}), '.5g') END)"
MEAL_ROWS = f"SELECT user_id, event_id, {NUTRIENT} AS name, {AMOUNT} AS amount FROM {{e}} WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_id, 'calorie count', '12.25' FROM {{e}} WHERE event_type = 'purchase' AND event_id % 3 = 0"


@query(
    "agg_session_totals",
    f"""
WITH n AS ({MEAL_ROWS.format(e='events', s='VARCHAR')}), v AS (SELECT user_id, event_id, lower(name) AS name, coalesce(try_cast(regexp_replace(amount, '[^0-9.]', '', 'g') AS DOUBLE), 0) AS v FROM n),
m AS (SELECT *, CASE WHEN contains(name, 'calorie') THEN 1 WHEN contains(name, 'protein') THEN 2 WHEN contains(name, 'fat') THEN 3 WHEN contains(name, 'carb') THEN 4 ELSE 0 END AS k FROM v),
t AS (SELECT user_id, count(DISTINCT event_id) AS meals, {', '.join(f"coalesce(sum(v) FILTER (k = {k}), 0) AS {total}" for k, (_, total) in enumerate(op.SESSION_MACROS, 1))} FROM m GROUP BY 1)
SELECT user_id, meals, {', '.join(f"round({total}, 4) AS {total}, round({total} / meals, 4) AS {total}_per_meal" for _, total in op.SESSION_MACROS)} FROM t""",
)
def agg_session_totals(spark, d):
    rows = spark.sql(MEAL_ROWS.format(e="{e}", s="string"), e=table(spark, d, "events"))
    return op.session_totals(rows, "user_id", "event_id", "name", "amount")


@query("agg_goal_gap", "WITH g AS (SELECT user_id, sum(value) AS t, (500 + user_id % 7 * 100)::DOUBLE AS goal FROM events GROUP BY 1) SELECT user_id, round(greatest(0, goal - t), 4) AS gap, round(100 * t / goal, 9) AS pct FROM g")
def agg_goal_gap(spark, d):
    goals = table(spark, d, "events").select("user_id").distinct().withColumn("goal", (500 + F.col("user_id") % 7 * 100).cast("double"))
    g = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("t")).join(goals, "user_id")
    return g.select("user_id", F.round(F.greatest(F.lit(0.0), F.col("goal") - F.col("t")), 4).alias("gap"), F.round(100 * F.col("t") / F.col("goal"), 9).alias("pct"))


@query("agg_domain_counts", f"SELECT {DOMAIN_SQL} AS domain, contains(url, 'blog') AS is_priority, count(*) AS n FROM pages GROUP BY 1, 2")
def agg_domain_counts(spark, d):
    return table(spark, d, "pages").groupBy(domain("url").alias("domain"), F.col("url").contains("blog").alias("is_priority")).agg(F.count(F.lit(1)).alias("n"))


SITE_SCORES = {"quality": "page_id % 100", "accuracy": "page_id % 10 * 10", "completeness": "page_id % 7 * 15"}


@query("agg_site_performance", f"SELECT {DOMAIN_SQL} AS domain, count(*) AS n, {', '.join(f'round(avg({x}), 1) AS {c}' for c, x in SITE_SCORES.items())} FROM pages GROUP BY 1")
def agg_site_performance(spark, d):
    scored = table(spark, d, "pages").select(domain("url").alias("domain"), *[F.expr(x).alias(c) for c, x in SITE_SCORES.items()])
    return op.site_performance(scored, "domain", list(SITE_SCORES))


@query("agg_session_score_means", f"SELECT user_id % 20 AS session, count(*) AS n, round(avg(speed), 9) AS speed, round(avg(quality), 9) AS quality, round(avg(accuracy), 9) AS accuracy FROM {SEARCH_SQL} GROUP BY 1")
def agg_session_score_means(spark, d):
    return searches(spark, d).groupBy((F.col("user_id") % 20).alias("session")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 9).alias(c) for c in ("speed", "quality", "accuracy")])


@query(
    "agg_intent_rollup",
    "SELECT user_id, event_type AS intent, max(value) OVER w AS best, count(*) OVER w AS found, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INTEGER AS attempt, event_id FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id, event_type)",
)
def agg_intent_rollup(spark, d):
    """The best result and the number of attempts of each intent, with a row per attempt: no row grows with an intent's attempts."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).select("user_id", F.col("event_type").alias("intent"), "value", "ts", "event_id")
    best = e.groupBy("user_id", "intent").agg(F.max("value").alias("best"), F.count(F.lit(1)).alias("found"))
    nth = F.row_number().over(Window.partitionBy("user_id", "intent").orderBy("ts", "event_id"))
    return e.withColumn("attempt", nth).join(best, ["user_id", "intent"]).select("user_id", "intent", "best", "found", "attempt", "event_id")


FAIL_SQL = "(SELECT user_id, event_id, ['search', 'parse', 'verify'][event_id % 3 + 1] AS failure_point, value FROM events WHERE event_type = 'error')"


@query("agg_failure_report", f"SELECT failure_point, count(*) AS n, round(sum(value), 4) AS lost FROM {FAIL_SQL} GROUP BY 1 UNION ALL SELECT 'total', count(*), round(sum(value), 4) FROM {FAIL_SQL}")
def agg_failure_report(spark, d):
    point = F.element_at(F.array(F.lit("search"), F.lit("parse"), F.lit("verify")), (F.col("event_id") % 3 + 1).cast("int"))
    g = table(spark, d, "events").filter("event_type = 'error'").withColumn("failure_point", point).rollup("failure_point").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("lost"))
    return g.withColumn("failure_point", F.coalesce("failure_point", F.lit("total")))


MESSAGES = ["HTTP 403", "Forbidden by robots", "Read Timeout", "timed out", "No recipe data found on page", "No data found", "Blocked", "rate limit reached"]
MESSAGE_SQL = f"({MESSAGES})[event_id % {len(MESSAGES)} + 1]"


def message():
    return F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))


@query("agg_error_classes", f"SELECT CASE WHEN regexp_matches(lower(m), '403|forbidden') THEN 'crawl_blocked' WHEN contains(lower(m), 'timeout') THEN 'timeout' WHEN contains(lower(m), 'no recipe data found') THEN 'no_data' ELSE 'other' END AS class, dom AS domain, count(*) AS n FROM (SELECT {MESSAGE_SQL} AS m, 'site' || (user_id % 5)::VARCHAR AS dom FROM events WHERE event_type = 'error') GROUP BY 1, 2")
def agg_error_classes(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'")
    return e.groupBy(op.error_class(message()).alias("class"), F.concat(F.lit("site"), (F.col("user_id") % 5).cast("string")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_parse_quality",
    """
WITH g AS (SELECT user_id, count(*) AS attempted, count(*) FILTER (event_type = 'view') AS ok, count(*) FILTER (event_type IN ('error', 'click')) AS failed, count(*) FILTER (value > 100) AS timeouts FROM events GROUP BY 1), r AS (SELECT *, ok::DOUBLE / nullif(ok + failed, 0) AS r FROM g)
SELECT user_id, attempted, ok, failed, timeouts, round(coalesce(r, 0), 2) AS success_rate, CASE WHEN r IS NULL THEN 'none' WHEN r >= 0.8 THEN 'excellent' WHEN r >= 0.6 THEN 'good' WHEN r >= 0.4 THEN 'acceptable' ELSE 'poor' END AS quality FROM r""",
)
def agg_parse_quality(spark, d):
    kind = F.col("event_type")
    return op.parse_quality(table(spark, d, "events"), ["user_id"], kind == "view", kind.isin("error", "click"), F.col("value") > 100)


@query(
    "agg_stage_summary",
    """
WITH s AS (SELECT user_id, event_type, round(sum(value), 3) AS dur FROM events GROUP BY 1, 2), t AS (SELECT user_id, string_agg(event_type || '=' || dur::VARCHAR, ';' ORDER BY event_type) AS durations FROM s GROUP BY 1),
e AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS n_errors, round(sum(value), 3) AS total, array_to_string((list(event_id ORDER BY ts, event_id) FILTER (event_type = 'error'))[1:5], ',') AS first_errors FROM events GROUP BY 1)
SELECT user_id, durations, total, n_errors, coalesce(first_errors, '') AS first_errors FROM t JOIN e USING (user_id)""",
)
def agg_stage_summary(spark, d):
    e = table(spark, d, "events")
    stages = e.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 3).alias("dur"), F.sum("value").alias("raw"), F.count(F.lit(1)).alias("n"))
    totals = stages.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "dur")))).alias("m"), F.round(F.sum("raw"), 3).alias("total"), F.sum(F.when(F.col("event_type") == "error", F.col("n")).otherwise(0)).alias("n_errors"))
    # a rank limit, which is applied before the shuffle too: at most five errors of a user are collected
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    first = e.filter("event_type = 'error'").select("user_id", "ts", "event_id").withColumn("k", nth).filter("k <= 5")
    errors = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", "event_id"))).alias("err"))
    shown = F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ";")
    listed = F.coalesce(F.array_join(F.transform("err", lambda x: x["event_id"].cast("string")), ","), F.lit(""))
    return totals.join(errors, "user_id", "left").select("user_id", shown.alias("durations"), "total", "n_errors", listed.alias("first_errors"))


JOB_SQL = "(SELECT user_id, event_id // 3 AS job, arg_max(CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'click' THEN 'processing' ELSE 'queued' END, (ts, event_id)) AS status FROM events GROUP BY 1, 2)"
def job_status():
    return F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "processing").otherwise("queued")


@query(
    "agg_queue_depth",
    f"""WITH u AS (SELECT user_id, count(*) FILTER (status = 'queued') AS depth, count(*) FILTER (status = 'processing') AS r FROM {JOB_SQL} GROUP BY 1), t AS (SELECT sum(r)::BIGINT AS active_slots, count(*) AS active_users FROM u)
SELECT user_id, depth, r > 0 AS running, active_slots, greatest(0, 22 - active_slots) AS free_slots, active_users FROM u CROSS JOIN t""",
)
def agg_queue_depth(spark, d):
    rows = table(spark, d, "events").select("user_id", F.concat_ws("-", F.col("user_id"), F.expr("event_id div 3")).alias("job"), "ts", "event_id", job_status().alias("status"))
    return op.queue_status(op.latest(rows, "job", ["ts", "event_id"], ["user_id", "status"]), "user_id", "status")


@query("agg_duplicate_audit", "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg_duplicate_audit(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("agg_batch_outcome", "WITH u AS (SELECT lower(props) AS k, min(event_id) AS e FROM events GROUP BY 1), r AS (SELECT event_type FROM u JOIN events ON event_id = e) SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed FROM r")
def agg_batch_outcome(spark, d):
    first = table(spark, d, "events").groupBy(F.lower("props").alias("k")).agg(F.min_by("event_type", "event_id").alias("t"))
    return first.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("t") != "error").alias("success"), F.count_if(F.col("t") == "error").alias("failed"))


@query(
    "agg_weighted_vote",
    """
WITH v AS (SELECT l_orderkey, sum(CASE WHEN l_quantity > 25 THEN 2 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END + CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::DOUBLE / count(*) AS vote, sum(l_extendedprice) AS kcal FROM lineitem GROUP BY 1)
SELECT l_orderkey, vote >= 3 AS is_total, round(CASE WHEN vote >= 3 THEN kcal ELSE kcal * (l_orderkey % 4 + 1) END, 2) AS calories FROM v""",
)
def agg_weighted_vote(spark, d):
    vote = lambda c, w: F.when(c, w).otherwise(0)
    votes = vote(F.col("l_quantity") > 25, 2) + vote(F.col("l_discount") > 0.05, 2) + vote(F.col("l_returnflag") == "N", 1) + vote(F.col("l_linestatus") == "O", 1)
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.sum(votes) / F.count(F.lit(1))).alias("vote"), F.sum("l_extendedprice").alias("kcal"))
    total = F.col("vote") >= 3
    return g.select("l_orderkey", total.alias("is_total"), F.round(F.when(total, F.col("kcal")).otherwise(F.col("kcal") * (F.col("l_orderkey") % 4 + 1)), 2).alias("calories"))


@query("agg_eval_nutrition", "WITH t AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_tax) AS x FROM lineitem GROUP BY 1) SELECT l_orderkey % 10 AS result_set, round(avg(((CASE WHEN q <= 120 THEN 1.0 ELSE 0.0 END) + (CASE WHEN x <= 0.2 THEN 1.0 ELSE 0.0 END)) / 2), 6)::DOUBLE AS score FROM t GROUP BY 1")
def agg_eval_nutrition(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("x"))
    met = (F.when(F.col("q") <= 120, 1.0).otherwise(0.0) + F.when(F.col("x") <= 0.2, 1.0).otherwise(0.0)) / 2
    return t.groupBy((F.col("l_orderkey") % 10).alias("result_set")).agg(F.round(F.avg(met), 6).alias("score"))


@query("agg_eval_dietary", "WITH d(tag, term) AS (VALUES ('vegan', 'ring'), ('vegan', 'bolt'), ('nut_free', 'gear')), v AS (SELECT p_partkey, tag, max(CASE WHEN contains(p_name, term) THEN 1 ELSE 0 END) AS bad FROM part CROSS JOIN d GROUP BY 1, 2), p AS (SELECT p_partkey, avg(1.0 - bad) AS s FROM v GROUP BY 1) SELECT p_brand, round(avg(s), 6)::DOUBLE AS score FROM p JOIN part USING (p_partkey) GROUP BY 1")
def agg_eval_dietary(spark, d):
    bad = lambda *terms: F.when(F.col("p_name").rlike("|".join(terms)), 0.0).otherwise(1.0)
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg((bad("ring", "bolt") + bad("gear")) / 2), 6).alias("score"))


@query("agg_eval_diversity", f"WITH c AS (SELECT page_id % 10 AS result_set, {DOMAIN_SQL} AS domain, count(*) AS n FROM pages GROUP BY 1, 2) SELECT result_set, least(1.0, round(count(*) FILTER (n <= 2)::DOUBLE / count(*) + CASE WHEN count(*) >= 3 THEN least(0.2, 0.1 * (count(*) - 2)) ELSE 0.0 END, 6))::DOUBLE AS diversity FROM c GROUP BY 1")
def agg_eval_diversity(spark, d):
    per = table(spark, d, "pages").groupBy((F.col("page_id") % 10).alias("result_set"), domain("url").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return op.domain_diversity(per, ["result_set"])


@query("agg_eval_completeness", "SELECT source, round(avg(0.8 * ((CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(lang) <> '' THEN 1 ELSE 0 END)) / 2 + 0.2 * (CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END)), 6)::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg_eval_completeness(spark, d):
    one = lambda c: F.when(c, 1).otherwise(0)
    return records(spark, d).groupBy("source").agg(F.round(F.avg(0.8 * (one(F.trim("text") != "") + one(F.trim("lang") != "")) / 2 + 0.2 * one(F.col("quality").isNotNull())), 6).alias("score"))


@query(
    "agg_eval_latency",
    """
WITH e AS (SELECT (['easy', 'medium', 'hard', 'odd'])[event_id % 4 + 1] AS difficulty, CASE WHEN event_id % 9 > 0 THEN value END AS v FROM events), f AS (SELECT *, CASE difficulty WHEN 'easy' THEN 0.7::DOUBLE WHEN 'hard' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS f FROM e)
SELECT difficulty, round(avg(CASE WHEN v IS NULL THEN 0.0 WHEN v <= 15 * f THEN 1.0 WHEN v <= 30 * f THEN 0.8 WHEN v <= 45 * f THEN 0.5 ELSE 0.2 END), 6)::DOUBLE AS score FROM f GROUP BY 1""",
)
def agg_eval_latency(spark, d):
    difficulty = F.element_at(F.array(*[F.lit(x) for x in ("easy", "medium", "hard", "odd")]), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, d, "events").select(difficulty.alias("difficulty"), F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("v"))
    return e.groupBy("difficulty").agg(F.round(F.avg(op.latency_score(F.col("v"), F.col("difficulty"))), 6).alias("score"))


@query(
    "agg_eval_success",
    """WITH g AS (SELECT user_id, max(CASE WHEN event_type = 'error' AND value > 80 THEN 1 ELSE 0 END) AS err, count(*) FILTER (event_type = 'view') AS found FROM events GROUP BY 1), x AS (SELECT *, CASE WHEN user_id % 3 > 0 THEN 10 + user_id % 30 ELSE 5 END AS want FROM g)
SELECT user_id, round(CASE WHEN err = 1 OR found = 0 THEN 0.0 WHEN found >= want THEN 1.0 ELSE found::DOUBLE / want END, 6)::DOUBLE AS score FROM x""",
)
def agg_eval_success(spark, d):
    kind = F.col("event_type")
    g = table(spark, d, "events").groupBy("user_id").agg(F.bool_or((kind == "error") & (F.col("value") > 80)).alias("err"), F.count_if(kind == "view").alias("found"))
    expected = F.when(F.col("user_id") % 3 > 0, 10 + F.col("user_id") % 30)
    return g.select("user_id", F.round(op.success_score(F.col("err"), F.col("found"), expected), 6).alias("score"))


@query(
    "agg_eval_efficiency",
    """
WITH r AS (SELECT user_id, max(value) > 150 AS early, count(*) FILTER (event_type = 'purchase') >= 12 AS exact, count(*) FILTER (event_type IN ('view', 'click'))::DOUBLE / count(*) AS processed FROM events GROUP BY 1)
SELECT user_id, least(1.0, round((CASE WHEN early THEN 0.3 ELSE 0.0 END) + (CASE WHEN exact THEN 0.4 ELSE 0.2 END) + 0.3 * processed, 6))::DOUBLE AS score FROM r""",
)
def agg_eval_efficiency(spark, d):
    r = table(spark, d, "events").groupBy("user_id").agg((F.max("value") > 150).alias("early"), (F.count_if(F.col("event_type") == "purchase") >= 12).alias("exact"), share(F.count_if(F.col("event_type").isin("view", "click")), F.count(F.lit(1))).alias("processed"))
    score = F.when(F.col("early"), 0.3).otherwise(0.0) + F.when(F.col("exact"), 0.4).otherwise(0.2) + 0.3 * F.coalesce("processed", F.lit(1.0))
    return r.select("user_id", F.least(F.lit(1.0), F.round(score, 6)).alias("score"))


@query(
    "agg_eval_error_handling",
    f"""WITH r AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 60) AS n, count(*) FILTER (event_type = 'error' AND value > 60 AND NOT regexp_matches(lower({MESSAGE_SQL}), '403|forbidden|timeout|rate limit')) AS odd FROM events GROUP BY 1)
SELECT user_id, (CASE WHEN user_id % 3 = 0 THEN CASE WHEN n = 0 THEN 0.5 WHEN odd * 2 <= n THEN 1.0 ELSE 0.3 END WHEN n = 0 THEN 1.0 WHEN odd > 0 THEN 0.1 ELSE 0.8 END)::DOUBLE AS score FROM r""",
)
def agg_eval_error_handling(spark, d):
    """An error run counts as classified where at least half of its errors are of the usual kinds."""
    error = (F.col("event_type") == "error") & (F.col("value") > 60)
    runs = table(spark, d, "events").groupBy("user_id").agg(F.count_if(error).alias("n"), F.count_if(error & ~op.usual_error(message())).alias("odd"))
    return runs.select("user_id", op.error_score(F.col("user_id") % 3 == 0, F.col("n"), F.col("odd"), F.col("odd") * 2 <= F.col("n")).alias("score"))


ANSWER = "concat(text, case conv_id % 11 when 0 then ' Step 1: preheat. https://x.org' when 1 then ' 1. Soup with egg' when 2 then ' 2 cups of rice' when 3 then ' \"Soup\" Recipe' when 4 then ' Save meal #3' when 5 then ' Save the quick one' when 6 then ' These might work.' when 7 then ' I found some: they meet your requirements' when 8 then ' Found recipes, or a close alternative' when 9 then ' best matches available' else '' end)".replace('\\"', '"')
BAD_SQL = " + ".join(f"(CASE WHEN regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END)" for p in op.FORBIDDEN)


@query(
    "agg_eval_text_rules",
    rf"""
WITH a AS (SELECT conv_id, turn, {ANSWER} AS t FROM conversations WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, {BAD_SQL} AS bad, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: trim(s) <> '')) AS sentences, regexp_matches(lower(t), '{op.SAVE}') AS saves, turn % 4 = 1 AS searched,
  CASE WHEN turn % 3 = 0 THEN CASE WHEN regexp_matches(lower(t), '{'|'.join(op.MIXED_WORDING)}') THEN 1.0 ELSE 0.3 END WHEN turn % 3 = 1 THEN CASE WHEN regexp_matches(lower(t), '{'|'.join(op.CLOSEST_WORDING)}') THEN 1.0 ELSE 0.2 END
   WHEN regexp_matches(lower(t), '{'|'.join(op.CONFIDENT_WORDING)}') AND NOT regexp_matches(lower(t), '{'|'.join(op.DOUBTFUL_WORDING)}') THEN 1.0 ELSE 0.6 END AS wording FROM a)
SELECT conv_id, round(avg(greatest(0.0, 1.0 - 0.3 * bad)), 6)::DOUBLE AS clean, round(avg(CASE WHEN sentences <= 2 THEN 1.0 WHEN sentences = 3 THEN 0.8 WHEN sentences <= 5 THEN 0.4 ELSE 0.1 END), 6)::DOUBLE AS brevity, round(avg(CASE WHEN saves THEN CASE WHEN searched THEN 0.0 ELSE 1.0 END WHEN searched THEN 1.0 ELSE 0.2 END), 6)::DOUBLE AS saving, round(avg(wording), 6)::DOUBLE AS wording, count(*) FILTER (saves) AS saves FROM r GROUP BY 1""",
)
def agg_eval_text_rules(spark, d):
    t, k = F.expr(ANSWER), F.col("turn")
    c = table(spark, d, "conversations").filter("role = 'assistant'").groupBy("conv_id")
    return c.agg(F.round(F.avg(op.clean_score(t)), 6).alias("clean"), F.round(F.avg(op.brevity_score(t)), 6).alias("brevity"), F.round(F.avg(op.save_score(t, k % 4 == 1)), 6).alias("saving"), F.round(F.avg(op.fallback_score(t, k % 3 < 2, F.when(k % 3 == 0, 1).otherwise(0))), 6).alias("wording"), F.count_if(F.lower(t).rlike(op.SAVE)).alias("saves"))


@query("agg_load_test", "SELECT event_type, count(*) AS requests, round(count(*) FILTER (value < 100)::DOUBLE / count(*), 6) AS success_rate, round(sum(value), 3) AS total_s, round(avg(value), 4) AS mean_s, round(count(*) / sum(value), 6) AS per_s FROM events GROUP BY 1")
def agg_load_test(spark, d):
    n, v = F.count(F.lit(1)), F.sum("value")
    return table(spark, d, "events").groupBy("event_type").agg(n.alias("requests"), F.round(share(F.count_if(F.col("value") < 100), n), 6).alias("success_rate"), F.round(v, 3).alias("total_s"), F.round(F.avg("value"), 4).alias("mean_s"), F.round(F.try_divide(n.cast("double"), v), 6).alias("per_s"))


@query("agg_timing_stats", "SELECT event_type, round(avg(value), 4) AS mean_s, min(value) AS min_s, max(value) AS max_s, count(*) AS runs FROM events GROUP BY 1")
def agg_timing_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean_s"), F.min("value").alias("min_s"), F.max("value").alias("max_s"), F.count(F.lit(1)).alias("runs"))
