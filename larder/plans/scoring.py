"""Queries: scores and tiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions import domain, grade
from larder.operators import scoring as op
from larder.plans.filters import DOMAIN_SQL, records
from larder.plans.registry import query, table
from larder.sources import spread

FILLED = "CASE WHEN {} IS NOT NULL AND trim({}::VARCHAR) <> '' THEN 1 ELSE 0 END"
GROUPS = [(0.6, ["text", "lang"]), (0.3, ["source", "quality"]), (0.1, ["toxic"])]
COMPLETE_SQL = "round(" + " + ".join(f"{w} * ({' + '.join(FILLED.format(c, c) for c in cols)}) / {len(cols)}" for w, cols in GROUPS) + ", 4)"
IMAGE = "CASE doc_id % 6 WHEN 0 THEN 'https://img/front_en.{n}.400.JPG' WHEN 1 THEN 'https://img/FRONT.{n}.600.jpg' WHEN 2 THEN 'https://img/side.{n}.600.jpg' WHEN 3 THEN 'https://img/Invalid/front.{n}.400.jpg' WHEN 4 THEN ' ' END".replace("{n}", "7")
VALID, SHARP = f"NOT contains(lower(trim(coalesce({IMAGE}, ''))), 'invalid')", f"regexp_matches(lower(coalesce({IMAGE}, '')), 'front') AND regexp_matches(coalesce({IMAGE}, ''), '[.][46]00[.]')"
TIER_SQL = f"CASE WHEN NOT coalesce(lang IN ('en', 'fr', 'de'), false) THEN 'rejected' WHEN completeness >= 0.8 AND {VALID} AND {SHARP} THEN 'tier1' WHEN completeness >= 0.6 AND {VALID} THEN 'tier2' WHEN completeness >= 0.4 AND {VALID} AND trim(coalesce({IMAGE}, '')) <> '' THEN 'tier3' ELSE 'rejected' END"
SCORED_SQL = f"(SELECT doc_id, lang, source, n_chars, quality, toxic, text, {COMPLETE_SQL} AS completeness FROM documents LEFT JOIN labels USING (doc_id))"
TIERED_SQL = f"(SELECT *, {TIER_SQL} AS quality_tier FROM {SCORED_SQL})"


def tiered(spark, d):
    scored = records(spark, d).withColumn("completeness", op.completeness(GROUPS))
    return scored.withColumn("quality_tier", op.quality_tier(F.col("completeness"), F.col("lang").isin("en", "fr", "de"), F.expr(IMAGE)))


@query("scr_completeness", f"SELECT doc_id, completeness FROM {SCORED_SQL}")
def scr_completeness(spark, d):
    return records(spark, d).select("doc_id", op.completeness(GROUPS).alias("completeness"))


@query("scr_quality_tier", f"SELECT doc_id, completeness, quality_tier FROM {TIERED_SQL}")
def scr_quality_tier(spark, d):
    return tiered(spark, d).select("doc_id", "completeness", "quality_tier")


GATE_SQL = "(trim(coalesce(text, '')) <> '' AND doc_id % 5 > 0 AND trim(coalesce(source, '')) <> '' AND coalesce(length(text), 0) > 10)"


@query("scr_required_gate", f"SELECT doc_id, {GATE_SQL} AS passed, CASE WHEN {GATE_SQL} THEN n_chars / 100.0 ELSE 0.0 END::DOUBLE AS score FROM documents")
def scr_required_gate(spark, d):
    image = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))).otherwise("none")
    gate = op.required_gate(F.col("text"), image, F.col("source"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", gate.alias("passed"), F.when(gate, F.col("n_chars") / 100.0).otherwise(0.0).alias("score"))


def benchmark_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), op.query_words(F.col("text")).alias("words"))


SHARE = "(CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_filter(words, lambda w: contains({}, w)))::DOUBLE / len(words) END)"
RELEVANCE_SQL = f"""
q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words FROM benchmark),
i AS (SELECT doc_id, lang, source, quality, toxic, n_chars, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')) AS title, lower(text) AS body, text FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT *, round(0.4 * (CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_intersect(words, title))::DOUBLE / len(words) END) + 0.3 * {SHARE.format('body')} + 0.2 * {SHARE.format('source')} + 0.1 * {SHARE.format('lang')}, 6) AS raw_score
  FROM i CROSS JOIN q),
r AS (SELECT doc_id, query_id, source, quality, toxic, n_chars, lang, text, CASE WHEN len(words) = 0 THEN 0.5 ELSE least(1.0, raw_score) END AS relevance FROM s)"""


def relevance_items(spark, d):
    """Whole texts as titles and ingredients, sources as descriptions, languages as categories."""
    docs = spread(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id", "left")
    return docs.select("doc_id", "lang", "source", "quality", "toxic", "n_chars", "text", op.title_words(F.col("text")).alias("title"), F.lower("text").alias("body"))


@query("scr_query_relevance", f"WITH {RELEVANCE_SQL} SELECT doc_id, query_id, relevance FROM r WHERE relevance > 0.2")
def scr_query_relevance(spark, d):
    found = op.query_relevance(relevance_items(spark, d), benchmark_queries(spark, d), "doc_id", "title", "body", "source", "lang", 0.2)
    return found.filter("relevance > 0.2")


@query(
    "scr_recipe_total",
    f"""WITH {RELEVANCE_SQL}, t AS (SELECT doc_id, query_id, CASE WHEN length(coalesce(text, '')) > 10 AND trim(text) <> '' AND trim(coalesce(source, '')) <> '' AND doc_id % 5 > 0 THEN least(1.0, round(0.70::DOUBLE * relevance
  + 0.13::DOUBLE * (((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT + (doc_id % 2 = 0)::INT)::DOUBLE / 4) + 0.02::DOUBLE * (((trim(coalesce(lang, '')) <> '')::INT + (doc_id % 3 = 0)::INT)::DOUBLE / 2)
  + 0.15::DOUBLE * (CASE WHEN source IN ('src1', 'src2', 'src3') THEN 1.0 ELSE 0.0 END), 7)) ELSE 0.0 END AS score FROM r) SELECT * FROM t WHERE score >= 0.3""",
)
def scr_recipe_total(spark, d):
    k = F.col("doc_id")
    image = F.when(k % 5 > 0, "https://example.org/x").otherwise("none")
    required = op.required_gate(F.col("text"), image, F.col("source"), F.col("text"))
    extras = op.recipe_extras([F.col("quality"), F.col("toxic"), F.col("n_chars"), F.when(k % 2 == 0, 1)], [F.col("lang"), F.when(k % 3 == 0, "x").otherwise(" ")], F.col("source").isin("src1", "src2", "src3"))
    items = relevance_items(spark, d).withColumns({"required": required, "extras": extras}).withColumn("needed", op.relevance_needed(F.col("required"), F.col("extras"), 0.3)).filter("needed <= 1")
    found = op.query_relevance(items, benchmark_queries(spark, d), "doc_id", "title", "body", "source", "lang", F.col("needed"), keep=["required", "extras"])
    return found.select("doc_id", "query_id", op.total_with(F.col("required"), F.col("relevance"), F.col("extras")).alias("score")).filter("score >= 0.3")


TIERS = [("thther.example.org", "trusted"), ("therea.example.net", "trusted"), ("ththin.example.com", "good"), ("ththed.example.org", "good")]
KEYWORDS = ["blog", "pills"]
TRUST_SQL = f"""(SELECT page_id, url, domain, CASE WHEN tier = 'trusted' THEN 60 WHEN tier = 'good' THEN 45 WHEN regexp_matches(domain, 'blog|pills') THEN 30 ELSE 15 END AS trust_points
  FROM (SELECT page_id, url, {DOMAIN_SQL} AS domain FROM pages) LEFT JOIN (VALUES {', '.join(f"('{s}', '{t}')" for s, t in TIERS)}) AS t(site, tier) ON domain = site)"""


def trusted(spark, d):
    tiers = spark.createDataFrame(TIERS, "site string, tier string")
    return op.site_trust(table(spark, d, "pages").select("page_id", "url", domain("url").alias("domain")), tiers, "domain", KEYWORDS)


@query("scr_site_trust", f"SELECT page_id, domain, trust_points FROM {TRUST_SQL}")
def scr_site_trust(spark, d):
    return trusted(spark, d).select("page_id", "domain", "trust_points")


#: A page has 0 to 4 images; the main one's name goes by the page, the scalar is used where there are none.
PICTURE = "concat(url, case page_id % 5 when 0 then '/img_1200.jpg' when 1 then '/thumb.jpg' when 2 then '/x150x.jpg' when 3 then '/Hero-1500.jpg' else '/plain.jpg' end)"
N_PICTURES = "(page_id // 5) % 5"
LARGE, THUMB = f"regexp_matches({PICTURE}, '1200|1500|large|hero')", f"regexp_matches({PICTURE}, 'thumb|150')"
IMG_POINTS_SQL = f"""(SELECT page_id, CASE WHEN {N_PICTURES} > 0 THEN least(30, (CASE WHEN {N_PICTURES} >= 3 THEN 25 WHEN {N_PICTURES} >= 2 THEN 20 ELSE 15 END) + (CASE WHEN {LARGE} THEN 5 WHEN {THUMB} THEN -5 ELSE 0 END))
  WHEN page_id % 2 = 0 THEN (CASE WHEN {LARGE} THEN 25 WHEN {THUMB} THEN 10 ELSE 15 END) ELSE 0 END AS points FROM pages)"""


@query("scr_image_points", f"SELECT page_id, points FROM {IMG_POINTS_SQL}")
def scr_image_points(spark, d):
    k, picture = F.col("page_id"), F.expr(PICTURE)
    return table(spark, d, "pages").select("page_id", op.image_points(F.expr("(page_id div 5) % 5"), picture, F.when(k % 2 == 0, picture).otherwise("")).alias("points"))


COUNTS_SQL = "(SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, coalesce(n, 0) AS n, coalesce(steps, 0) AS steps FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS steps FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"
Q_ITEM_SQL = f"(SELECT *, least(100, 15 + 15 * (o_orderkey % 4) + 15 * (o_orderkey % 3) + (CASE WHEN n >= 5 AND steps >= 3 THEN 15 WHEN n >= 3 AND steps >= 2 THEN 10 ELSE 5 END))::DOUBLE AS quality FROM {COUNTS_SQL})"
C_ITEM_SQL = f"(SELECT *, least(100, (CASE WHEN o_orderkey % 9 > 0 THEN 10 ELSE 0 END) + least(25, 3 * n) + least(25, 4 * steps) + (CASE WHEN o_orderkey % 5 >= 3 THEN 15 WHEN o_orderkey % 5 > 0 OR o_orderkey % 7 = 0 THEN 10 ELSE 0 END) + (CASE WHEN o_orderkey % 5 > 0 THEN 10 ELSE 0 END) + (CASE WHEN o_orderkey % 4 > 0 THEN 10 ELSE 0 END) + (CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 0 END))::DOUBLE AS complete FROM {Q_ITEM_SQL})"
#: Every fifth item has no constraints and is judged by the words of a query.
SEARCH_TEXT = "urgent high specified low"
A_ITEM_SQL = f"(SELECT *, (CASE WHEN o_orderkey % 5 = 0 THEN least(100.0, len(list_filter(string_split('{SEARCH_TEXT}', ' '), lambda w: length(w) > 3 AND contains(lower(o_orderpriority), w)))::DOUBLE / 4 * 100 + 50) ELSE ((o_totalprice < 200000)::INT + (n <= 5)::INT + (year(o_orderdate) >= 1997)::INT)::DOUBLE / 3 * 100 END)::DOUBLE AS accuracy FROM {C_ITEM_SQL})"


def items(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("steps"))
    o = table(spark, d, "orders").join(n, "o_orderkey", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "steps": F.coalesce("steps", F.lit(0))})
    k, one = F.col("o_orderkey"), lambda c: c.cast("int")
    quality = op.item_quality(15 + 15 * (k % 4), 15 * (k % 3), op.content_points(F.col("n"), F.col("steps"))).cast("double")
    complete = op.item_completeness(k % 9 > 0, F.col("n"), F.col("steps"), k % 5, F.when(k % 7 == 0, "x"), k % 5 > 0, k % 4 > 0, k % 2 == 0).cast("double")
    met = one(F.col("o_totalprice") < 200000) + one(F.col("n") <= 5) + one(F.year("o_orderdate") >= 1997)
    accuracy = op.constraint_accuracy(met, F.when(k % 5 == 0, 0).otherwise(3), F.lit(SEARCH_TEXT), F.col("o_orderpriority"))
    return o.withColumns({"quality": quality, "complete": complete, "accuracy": accuracy})


@query("scr_item_quality", f"SELECT o_orderkey, quality FROM {Q_ITEM_SQL}")
def scr_item_quality(spark, d):
    return items(spark, d).select("o_orderkey", "quality")


@query("scr_item_completeness", f"SELECT o_orderkey, complete FROM {C_ITEM_SQL}")
def scr_item_completeness(spark, d):
    return items(spark, d).select("o_orderkey", "complete")


@query("scr_constraint_accuracy", f"SELECT o_orderkey, round(accuracy, 6) AS accuracy FROM {A_ITEM_SQL}")
def scr_constraint_accuracy(spark, d):
    return items(spark, d).select("o_orderkey", F.round("accuracy", 6).alias("accuracy"))


@query("scr_item_overall", f"SELECT o_orderkey, round(0.40 * quality + 0.35 * accuracy + 0.25 * complete, 1) AS overall FROM {A_ITEM_SQL}")
def scr_item_overall(spark, d):
    return items(spark, d).select("o_orderkey", op.item_overall(F.col("quality"), F.col("accuracy"), F.col("complete")).alias("overall"))


SPEED_SQL = "CASE WHEN s <= 12 THEN 100.0 WHEN s <= 20 THEN 80.0 WHEN s <= 40 THEN 60.0 ELSE greatest(10.0, 60.0 - (s - 40) * 1.5) END"
SEARCH_SQL = f"(SELECT user_id, round({SPEED_SQL}, 3) AS speed, q AS quality, a AS accuracy, round(0.5 * ({SPEED_SQL}) + 0.3 * q + 0.2 * a, 3) AS overall FROM (SELECT user_id, max(value) / 5 AS s, avg(CASE WHEN event_type IN ('view', 'click') THEN 80.0 ELSE 40.0 END) AS q, avg(CASE WHEN event_type = 'purchase' THEN 100.0 ELSE 0.0 END) AS a FROM events GROUP BY 1))"


def searches(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(
        (F.max("value") / 5).alias("s"), F.avg(F.when(F.col("event_type").isin("view", "click"), 80.0).otherwise(40.0)).alias("quality"), F.avg(F.when(F.col("event_type") == "purchase", 100.0).otherwise(0.0)).alias("accuracy")
    )
    speed = op.speed_score(F.col("s"))
    return g.select("user_id", F.round(speed, 3).alias("speed"), "quality", "accuracy", F.round(0.5 * speed + 0.3 * F.col("quality") + 0.2 * F.col("accuracy"), 3).alias("overall"))


@query("scr_search_overall", f"SELECT user_id, speed, overall FROM {SEARCH_SQL}")
def scr_search_overall(spark, d):
    return searches(spark, d).select("user_id", "speed", "overall")


@query("scr_grade", f"SELECT user_id, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' ELSE 'F' END AS grade FROM {SEARCH_SQL}")
def scr_grade(spark, d):
    return searches(spark, d).select("user_id", grade(F.col("overall")).alias("grade"))


@query(
    "scr_time_status",
    """
WITH b(event_type, strategy, budget) AS (VALUES ('click', 'priority_only', 30.0), ('view', 'mixed', 60.0), ('purchase', 'broad', 90.0)),
s AS (SELECT event_id, value, CASE WHEN value > coalesce(budget, 60.0) THEN 'exceeded' WHEN value > 0.5 * coalesce(budget, 60.0) THEN 'approaching_limit' ELSE 'on_track' END AS status FROM events LEFT JOIN b USING (event_type))
SELECT event_id, status, CASE WHEN value > 60 THEN 'ask_user' WHEN value > 30 AND event_id % 13 < 10 THEN 'pivot' WHEN event_id % 13 < 5 THEN 'expand' ELSE 'continue' END AS action FROM s""",
)
def scr_time_status(spark, d):
    strategy = F.coalesce(*[F.when(F.col("event_type") == e, s) for e, s in (("click", "priority_only"), ("view", "mixed"), ("purchase", "broad"))], F.lit("other"))
    return table(spark, d, "events").select("event_id", op.time_status(F.col("value"), strategy).alias("status"), op.next_action(F.col("value"), F.col("event_id") % 13).alias("action"))


SAID = "concat(text, CASE (conv_id + turn) % 7 WHEN 0 THEN ' The FIRST one' WHEN 1 THEN ' recipe #2' WHEN 2 THEN ' the third' WHEN 3 THEN ' the last quick one' WHEN 4 THEN ' the quick Italian one' WHEN 5 THEN ' the second' ELSE '' END)"
SHOWN = "concat(split_part(text, '.', 1), CASE conv_id % 3 WHEN 0 THEN ' Italian French' WHEN 1 THEN ' Asian' ELSE '' END)"


def _reference_sql():
    style = " + ".join(f"(CASE WHEN contains(said, '{c}') AND contains(title, '{c}') THEN 0.8 ELSE 0.0 END)" for c in op.CUISINES)
    place = " ".join(f"WHEN contains(said, '{w}') OR contains(said, '#{k}') THEN CASE WHEN position = {k} THEN 1.0 ELSE 0.0 END" for k, w in enumerate(("first", "second", "third"), 1))
    return f"""
WITH u AS (SELECT conv_id, turn, lower({SAID}) AS said FROM conversations WHERE role = 'user'),
i AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, lower({SHOWN}) AS title, length(text) % 60 AS minutes FROM conversations WHERE role = 'assistant'),
s AS (SELECT u.conv_id, turn, position, round(least(1.0, (CASE WHEN len(list_filter(string_split_regex(said, '\\s+'), lambda w: length(w) > 3 AND contains(title, w))) > 0 THEN 0.5 ELSE 0.0 END)
  + (CASE {place} WHEN contains(said, 'last') THEN CASE WHEN position >= 3 THEN 0.8 ELSE 0.0 END ELSE 0.0 END) + (CASE WHEN contains(said, 'quick') AND minutes BETWEEN 1 AND 30 THEN 0.7 ELSE 0.0 END) + {style}), 6)::DOUBLE AS score FROM u JOIN i USING (conv_id))
SELECT conv_id, turn, arg_min(position, (-score, position)) AS best, max(score) AS score FROM s WHERE score > 0 GROUP BY 1, 2"""


@query("scr_reference_match", _reference_sql())
def scr_reference_match(spark, d):
    c = table(spark, d, "conversations")
    said = c.filter("role = 'user'").select("conv_id", "turn", F.expr(SAID).alias("said"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    shown = c.filter("role = 'assistant'").select("conv_id", nth.cast("long").alias("best"), F.expr(SHOWN).alias("title"), (F.length("text") % 60).alias("minutes"))
    pairs = said.join(shown, "conv_id").select("conv_id", "turn", "best", op.reference_match(F.col("said"), F.col("title"), F.col("best"), F.col("minutes")).alias("score"))
    return op.best_reference(pairs, ["conv_id", "turn"], "best", "score")


#: The pages' links under the paths of recipes, lists and others, by the page.
LINK_URL = "concat('https://Example.org', case page_id % 7 when 0 then '/recipe' when 1 then '/recipes/category' when 2 then '/2024/05' when 3 then '/about' when 4 then '/recipes' when 5 then '/guide' else '/page' end, href, case when page_id % 3 = 0 then '-recipe' else '' end)"
LINK_TEXT = "concat(label, case length(label) % 3 when 0 then ' Soup' when 1 then ' with seven more words' else '' end)"
AROUND = "case when page_id % 4 = 1 then '20 Minutes, serves 4' else 'more' end"


@query(
    "scr_link_confidence",
    rf"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages),
x AS (SELECT page_id, {LINK_URL} AS url, {LINK_TEXT} AS label FROM l),
s AS (SELECT page_id, url, label, CASE WHEN NOT regexp_matches(lower(url), '{'|'.join(op.LIST_URLS)}') AND NOT regexp_matches(lower(url), '{'|'.join(op.OTHER_URLS)}') AND regexp_matches(lower(url), '{'|'.join(op.RECIPE_URLS)}') THEN
  (CASE WHEN contains(lower(url), 'recipe') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(lower(label), '{'|'.join(op.FOOD_WORDS)}') THEN 2 ELSE 0 END) + (CASE WHEN length(label) BETWEEN 10 AND 100 THEN 1 ELSE 0 END) + (CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END)
  + (CASE WHEN regexp_matches(lower({AROUND}), '{'|'.join(op.CONTEXT_WORDS)}') THEN 1 ELSE 0 END) ELSE 0 END AS confidence FROM x)
SELECT * FROM s WHERE confidence >= 3""",
)
def scr_link_confidence(spark, d):
    pattern = F.lit(r'<a href="([^"]*)">([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("label"))
    links = table(spark, d, "pages").select("page_id", F.inline(both)).select("page_id", F.expr(LINK_URL).alias("url"), F.expr(LINK_TEXT).alias("label"))
    return links.withColumn("confidence", op.link_confidence(F.col("url"), F.col("label"), F.col("page_id") % 2 == 0, F.expr(AROUND))).filter("confidence >= 3")


TITLE = "concat(regexp_extract(html, '<title>([^<]*)', 1), case page_id % 6 when 0 then ' Best soups' when 1 then ' soup Recipe' else '' end)"


@query(
    "scr_url_type",
    f"""
WITH t AS (SELECT CASE WHEN page_id % 5 = 0 THEN url || '/Recipe/soup' ELSE url END AS url, lower({TITLE}) AS title FROM pages),
c AS (SELECT CASE WHEN regexp_matches(title, 'best|top|recipes|roundup') THEN 'list' WHEN contains(lower(url), '/recipe/') OR contains(title, 'recipe') THEN 'recipe' ELSE 'other' END AS kind FROM t)
SELECT kind, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY 1""",
)
def scr_url_type(spark, d):
    url = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/Recipe/soup"))).otherwise(F.col("url"))
    kinds = table(spark, d, "pages").select(op.url_type(F.expr(TITLE), url).alias("kind"))
    counts = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("kind", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
