"""Queries: joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import domain
from larder.operators import lookups as op
from larder.plans.filters import DOMAIN_SQL
from larder.plans.registry import query, table

ALIAS_SQL = "(SELECT l_partkey AS ingredient_id, lower('Alias ' || l_partkey::VARCHAR || '-' || l_linenumber::VARCHAR) AS alias_text, count(*) AS usage_count, round(sum(l_discount) / count(*), 6) AS confidence, max(l_shipdate) AS updated_at, CASE WHEN l_partkey % 5 = 0 THEN 'inactive' ELSE 'active' END AS status FROM lineitem GROUP BY l_partkey, l_linenumber)"
INGREDIENT_SQL = "(SELECT p_partkey AS ingredient_id, p_name AS name, n_name AS category_name FROM part JOIN nation ON n_nationkey = p_partkey % 25)"


def aliases(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.count(F.lit(1)).alias("usage_count"), F.round(F.sum("l_discount") / F.count(F.lit(1)), 6).alias("confidence"), F.max("l_shipdate").alias("updated_at"))
    text = F.concat(F.lit("Alias "), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return g.select(F.col("l_partkey").alias("ingredient_id"), text.alias("alias_text"), "usage_count", "confidence", "updated_at", F.when(F.col("l_partkey") % 5 == 0, "inactive").otherwise("active").alias("status"))


def ingredients(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("category_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("ingredient_id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 25).alias("k")).join(n, "k").drop("k")


@query("jn_alias_lookup", f"SELECT alias_text, ingredient_id, name, category_name FROM {ALIAS_SQL} JOIN {INGREDIENT_SQL} USING (ingredient_id) WHERE status = 'active'")
def jn_alias_lookup(spark, d):
    return op.alias_lookup(aliases(spark, d), ingredients(spark, d)).select("alias_text", "ingredient_id", "name", "category_name")


@query("jn_alias_sync", f"SELECT ingredient_id, alias_text, confidence, name, count(*) OVER (PARTITION BY ingredient_id) AS n_aliases FROM {ALIAS_SQL} JOIN {INGREDIENT_SQL} USING (ingredient_id) WHERE status = 'active' AND updated_at >= TIMESTAMP '2000-01-01'")
def jn_alias_sync(spark, d):
    a = op.alias_lookup(aliases(spark, d).filter("updated_at >= timestamp'2000-01-01'"), ingredients(spark, d))
    n = a.groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("n_aliases"))
    return a.join(n, "ingredient_id").select("ingredient_id", "alias_text", "confidence", "name", "n_aliases")


@query("jn_category_default", "SELECT p_partkey, p_type, coalesce(image, 'other.png') AS image FROM part LEFT JOIN (VALUES ('PROMO', 'promo.png'), ('SMALL', 'small.png')) AS t(k, image) ON k = p_type")
def jn_category_default(spark, d):
    images = spark.createDataFrame([("PROMO", "promo.png"), ("SMALL", "small.png"), ("default", "other.png")], "p_type string, image string")
    return op.with_default(table(spark, d, "part"), images, "p_type", "image", "default").select("p_partkey", "p_type", "image")


DENSITIES = [("ring", 120.0), ("hot ring", 127.0), ("bolt", 50.0), ("old", 80.0), ("gear", 90.0), ("re", 33.0)]
DENSITY_VALUES = ", ".join(f"({k}, '{key}', {v})" for k, (key, v) in enumerate(DENSITIES))


def densities(spark):
    return spark.createDataFrame([(k, key, v) for k, (key, v) in enumerate(DENSITIES)], "ordinal int, key string, value double")


@query("jn_dict_first_match", f"SELECT p_partkey, p_name, (SELECT arg_min(v, o) FROM (VALUES {DENSITY_VALUES}) AS t(o, k, v) WHERE contains(lower(p_name), k))::DOUBLE AS value FROM part")
def jn_dict_first_match(spark, d):
    return op.first_match(table(spark, d, "part"), densities(spark), "p_name").select("p_partkey", "p_name", "value")


@query("jn_dict_word_match", f"SELECT p_partkey, coalesce((SELECT arg_min(v, o) FROM (VALUES {DENSITY_VALUES}) AS t(o, k, v) WHERE regexp_matches(lower(p_name), '\\b' || k || '\\b'))::VARCHAR, '') AS category FROM part")
def jn_dict_word_match(spark, d):
    out = op.first_match(table(spark, d, "part"), densities(spark), "p_name", whole_word=True)
    return out.select("p_partkey", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("category"))


MACROS = ["calories", "protein", "fat", "carbs"]
DEFAULTS = {"calories": 100.0, "protein": 5.0, "fat": 3.0, "carbs": 15.0}
PART_MACROS_SQL = "p_retailprice AS calories, (p_size % 30)::DOUBLE AS protein, (p_size % 20)::DOUBLE AS fat, (p_size % 40)::DOUBLE AS carbs"
TIERED_LINES_SQL = f"""(SELECT l.*, p_name, CASE WHEN l_partkey % 3 = 0 THEN 'reference' WHEN l_partkey % 3 = 1 THEN 'estimate' ELSE 'default' END AS source,
  CASE l_partkey % 3 WHEN 0 THEN calories WHEN 1 THEN calories / 2 ELSE 100.0 END AS calories, CASE l_partkey % 3 WHEN 0 THEN protein WHEN 1 THEN protein / 2 ELSE 5.0 END AS protein,
  CASE l_partkey % 3 WHEN 0 THEN fat WHEN 1 THEN fat / 2 ELSE 3.0 END AS fat, CASE l_partkey % 3 WHEN 0 THEN carbs WHEN 1 THEN carbs / 2 ELSE 15.0 END AS carbs
  FROM lineitem l JOIN (SELECT p_partkey, p_name, {PART_MACROS_SQL} FROM part) ON p_partkey = l_partkey)"""


def part_macros(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.col("p_retailprice").alias("calories"), (s % 30).cast("double").alias("protein"), (s % 20).cast("double").alias("fat"), (s % 40).cast("double").alias("carbs"))


def tiered_lines(spark, d):
    """Recipe lines with per-100 values of a reference, an estimate or defaults."""
    p = part_macros(spark, d)
    reference = p.filter("l_partkey % 3 = 0")
    estimates = p.filter("l_partkey % 3 = 1").select("l_partkey", *[(F.col(m) / 2).alias(m) for m in MACROS])
    lines = table(spark, d, "lineitem").join(p.select("l_partkey", "p_name"), "l_partkey")
    return op.nutrition_tiered(lines, reference, estimates, "l_partkey", MACROS, DEFAULTS)


@query("jn_nutrition_tiered", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, source, calories, protein, fat, carbs FROM {TIERED_LINES_SQL}")
def jn_nutrition_tiered(spark, d):
    return tiered_lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "source", *MACROS)


#: Names as they come: with blanks, capitals and preparations.
RAW_NAME = "(CASE p_partkey % 12 WHEN 0 THEN ' Eggs ' WHEN 1 THEN 'raw egg' WHEN 2 THEN 'Butter' WHEN 3 THEN 'Fried eggs, boiled' WHEN 4 THEN 'EGG' WHEN 5 THEN 'Brown Sugar' WHEN 6 THEN concat('Roasted ', p_name) WHEN 7 THEN 'Oats' WHEN 8 THEN 'Strawberry' ELSE p_name END)"
PREPARED_SQL = "CASE " + " ".join(f"WHEN contains(lower(n), '{w}') THEN '{w}'" for w in op.PREPARATIONS) + " END"


@query(
    "jn_search_term_map",
    f"""WITH p AS (SELECT p_partkey, {RAW_NAME} AS n FROM part), t AS (SELECT p_partkey, coalesce(canonical, n) AS t, {PREPARED_SQL} AS w FROM p LEFT JOIN (VALUES {', '.join(str(x) for x in op.SEARCH_NAMES.items())}) AS m(common, canonical) ON common = lower(trim(n)))
SELECT p_partkey, CASE WHEN w IS NOT NULL AND NOT contains(lower(t), w) THEN t || ' ' || w ELSE t END AS search_term FROM t""",
)
def jn_search_term_map(spark, d):
    named = table(spark, d, "part").select("p_partkey", F.expr(RAW_NAME).alias("name"))
    return op.search_terms(named, "name").select("p_partkey", "search_term")


UNITS = ["cups", "tablespoon", "gram", "slices", "piece", "oz", "pinch"]
UNIT_SQL = "(['cups', 'tablespoon', 'gram', 'slices', 'piece', 'oz', 'pinch'])[l_linenumber]"
PORTIONS_SQL = "[{'unit': 'cup', 'grams': (l_partkey % 4) * 60.0}, {'unit': 'slice', 'grams': 30.0}, {'unit': 'large piece', 'grams': 55.0}]"
PORTION_SQL = f"(list_filter({PORTIONS_SQL}, lambda p: p.grams > 0 AND (contains(regexp_replace(p.unit, 's$', ''), regexp_replace(unit, 's$', '')) OR contains(regexp_replace(unit, 's$', ''), regexp_replace(p.unit, 's$', '')))))[1].grams::DOUBLE"


def line_unit():
    return F.element_at(F.array(*[F.lit(u) for u in UNITS]), F.col("l_linenumber"))


def portions():
    pair = lambda unit, grams: F.struct(F.lit(unit).alias("unit"), grams.cast("double").alias("grams"))
    return F.array(pair("cup", (F.col("l_partkey") % 4) * 60), pair("slice", F.lit(30)), pair("large piece", F.lit(55)))


@query("jn_portion_match", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unit, {PORTION_SQL} AS grams FROM (SELECT *, {UNIT_SQL} AS unit FROM lineitem)")
def jn_portion_match(spark, d):
    lines = table(spark, d, "lineitem").withColumn("unit", line_unit())
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "unit", op.portion_match(F.col("unit"), portions()).alias("grams"))


@query("jn_exclude_shown", "SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view') AND page_id NOT IN (3, 200)")
def jn_exclude_shown(spark, d):
    shown = table(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("page_id")).distinct()
    explicit = spark.createDataFrame([(3,), (200,)], "page_id long")
    return table(spark, d, "pages").join(shown, "page_id", "left_anti").join(explicit, "page_id", "left_anti").select("page_id", "url")


@query("jn_failed_urls", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_failed_urls(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query(
    "jn_fuzzy_variants",
    """
WITH n AS (SELECT lower(p_name) AS o, count(*) AS n FROM part GROUP BY 1), t(target) AS (VALUES ('bolts'), ('widgit'), ('anvil')),
s AS (SELECT target, o, n, round(100 * (1 - list_min(list_transform(range(1, greatest(length(o) - length(target) + 1, 1) + 1), lambda i: levenshtein(target, substring(o, i, length(target))))) / length(target)), 2) AS sim FROM n CROSS JOIN t)
SELECT target, sum(n)::BIGINT AS total, array_to_string(list(o ORDER BY o), ',') AS variants FROM s WHERE sim >= 70 GROUP BY 1""",
)
def jn_fuzzy_variants(spark, d):
    targets = spark.createDataFrame([("bolts",), ("widgit",), ("anvil",)], "target string")
    return op.fuzzy_variants(table(spark, d, "part"), targets, "p_name").withColumn("variants", F.array_join("variants", ","))


@query(
    "jn_step_ingredients",
    """
WITH v AS (SELECT DISTINCT l_orderkey, l_partkey % 10 AS ing FROM lineitem), s AS (SELECT o_orderkey, unnest(range(1, (1 + o_orderkey % 4)::BIGINT)) AS step FROM orders),
w AS (SELECT o_orderkey, step, unnest([step, (o_orderkey + step) % 10, 77]) AS ing FROM s), k AS (SELECT DISTINCT w.* FROM w JOIN v ON l_orderkey = o_orderkey AND v.ing = w.ing)
SELECT s.o_orderkey, s.step::INTEGER AS step, coalesce(array_to_string(list(k.ing ORDER BY k.ing) FILTER (k.ing IS NOT NULL), ','), '') AS ingredients FROM s LEFT JOIN k USING (o_orderkey, step) GROUP BY 1, 2""",
)
def jn_step_ingredients(spark, d):
    valid = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 10).alias("ing")).distinct()
    steps = table(spark, d, "orders").select("o_orderkey", F.explode(F.slice(F.sequence(F.lit(1), F.lit(3)), 1, (F.col("o_orderkey") % 4).cast("int"))).alias("step"))
    text = F.concat_ws(",", F.col("step").cast("string"), ((F.col("o_orderkey") + F.col("step")) % 10).cast("string"), F.lit("77"))
    named = steps.select("o_orderkey", "step", F.explode(F.split(text, ",").cast("array<bigint>")).alias("ing")).join(valid, ["o_orderkey", "ing"], "left_semi")
    found = named.groupBy("o_orderkey", "step").agg(F.array_sort(F.collect_set("ing")).alias("ids"))
    return steps.join(found, ["o_orderkey", "step"], "left").select("o_orderkey", "step", F.array_join(F.coalesce("ids", F.array().cast("array<bigint>")).cast("array<string>"), ",").alias("ingredients"))


LINKS_SQL = r"""l AS (SELECT page_id, unnest(range(1, len(h) + 1))::INTEGER AS link_pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages))"""


def links(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("link_pos", "href")).withColumn("link_pos", F.col("link_pos") + 1)


@query(
    "jn_list_expand",
    f"""
WITH c AS (SELECT page_id % 10 AS query_id, page_id AS pos, page_id, url, page_id % 3 = 0 AS is_list FROM pages), {LINKS_SQL},
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM c WHERE is_list),
b AS (SELECT query_id, pos, link_pos, href AS url, page_id AS source_page, row_number() OVER (PARTITION BY query_id, page_id ORDER BY link_pos) AS k FROM a JOIN l USING (page_id) WHERE r <= 6),
u AS (SELECT query_id, pos, 0 AS link_pos, url, NULL AS source_page FROM c WHERE NOT is_list UNION ALL SELECT query_id, pos, link_pos, url, source_page FROM b WHERE k <= 5),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, link_pos) AS position FROM u)
SELECT query_id, url, source_page, position::INTEGER AS position FROM n WHERE position <= 60""",
)
def jn_list_expand(spark, d):
    candidates = table(spark, d, "pages").select((F.col("page_id") % 10).alias("query_id"), F.col("page_id").alias("pos"), "page_id", "url", F.when(F.col("page_id") % 3 == 0, "list").otherwise("recipe").alias("kind"))
    return op.expand_lists(candidates, links(spark, d)).select("query_id", "url", "source_page", "position")


@query("jn_missing_steps", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'missing' ELSE role END AS step_type, length(text) AS n FROM conversations")
def jn_missing_steps(spark, d):
    original = table(spark, d, "conversations")
    classified = original.filter("turn % 3 <> 2").select("conv_id", "turn", F.col("role").alias("step_type"))
    return original.join(classified, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("step_type", F.lit("missing")).alias("step_type"), F.length("text").cast("long").alias("n"))
