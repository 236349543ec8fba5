"""Queries: requirement checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import domain
from larder.operators import requirements as op
from larder.plans.filters import DOMAIN_SQL, records
from larder.plans.registry import query, table
from larder.sources import spread

REQUIREMENTS = """concat('{"nutrition":{"protein":{"min":', cast(q % 30 as {s}), '},"iron":{"max":', cast(q % 900 as {s}), '},"zinc":{}},"time_constraints":"UNDER ', cast(10 + q % 50 as {s}), ' minutes","allergies":["Peanut"],"exclude_ingredients":["Ring","bolt"],"include_ingredients":["egg"],',
 case q % 3 when 0 then '"dietary_restrictions":"Gluten-Free","meal_type":"lunch"' when 1 then '"dietary_restrictions":["Vegan","low fodmap","Halal"]' else '"cuisine_type":"thai"' end, '}')"""


@query(
    "req_categorise",
    """
WITH u AS (SELECT DISTINCT c_custkey AS q FROM customer)
SELECT q, 'nutrition' AS kind, 'protein' AS name, (q % 30)::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::VARCHAR AS term FROM u UNION ALL SELECT q, 'nutrition', 'iron', NULL, (q % 900)::DOUBLE, NULL FROM u
UNION ALL SELECT q, 'time', 'cook_time', NULL, (10 + q % 50)::DOUBLE, NULL FROM u UNION ALL SELECT q, 'exclude', 'term', NULL, NULL, unnest(['Peanut', 'Ring', 'bolt']) FROM u UNION ALL SELECT q, 'include', 'term', NULL, NULL, 'egg' FROM u
UNION ALL SELECT q, 'dietary', 'term', NULL, NULL, 'gluten_free' FROM u WHERE q % 3 = 0 UNION ALL SELECT q, 'subjective', 'meal_type', NULL, NULL, 'lunch' FROM u WHERE q % 3 = 0
UNION ALL SELECT q, 'dietary', 'term', NULL, NULL, 'vegan' FROM u WHERE q % 3 = 1 UNION ALL SELECT q, 'subjective', 'dietary_restriction', NULL, NULL, 'Halal' FROM u WHERE q % 3 = 1
UNION ALL SELECT q, 'subjective', 'cuisine_type', NULL, NULL, 'thai' FROM u WHERE q % 3 = 2""",
)
def req_categorise(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("q")).distinct().withColumn("doc", F.expr(REQUIREMENTS.replace("{s}", "string")))
    return op.categorise(docs, "q", "doc")


VALUES_SQL = "(SELECT l_orderkey, sum(l_quantity) AS protein, round(sum(l_extendedprice) / 100, 2) AS calories FROM lineitem GROUP BY 1)"
#: Every seventh recipe has no protein value, and the orders without lines have none at all.
NUTRITION_SQL = f"""(SELECT l_orderkey, bool_and(pct >= 100) AS nutrition_ok, round(sum(pct) / 2, 1) AS nutrition_pct FROM (
  SELECT o_orderkey AS l_orderkey, CASE WHEN protein IS NULL OR l_orderkey % 7 = 0 THEN 0.0 WHEN protein >= 90 THEN 100.0 ELSE 100 * protein / 90 END::DOUBLE AS pct FROM orders LEFT JOIN {VALUES_SQL} ON l_orderkey = o_orderkey
  UNION ALL SELECT o_orderkey, CASE WHEN calories IS NULL THEN 0.0 WHEN calories <= 2500 THEN 100.0 ELSE 100 * 2500 / calories END::DOUBLE FROM orders LEFT JOIN {VALUES_SQL} ON l_orderkey = o_orderkey) GROUP BY 1)"""


def nutrition(spark, d):
    v = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("protein"), F.round(F.sum("l_extendedprice") / 100, 2).alias("calories"))
    values = v.unpivot("l_orderkey", ["protein", "calories"], "name", "value").filter("name = 'calories' or l_orderkey % 7 > 0")
    needs = spark.createDataFrame([("protein", 90.0, None), ("calories", None, 2500.0)], "name string, lo double, hi double")
    return op.nutrition_match(values, needs, "l_orderkey", table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")))


@query("req_nutrition_match", f"SELECT l_orderkey, nutrition_ok, floor(nutrition_pct) AS nutrition_pct FROM {NUTRITION_SQL}")
def req_nutrition_match(spark, d):
    return nutrition(spark, d).withColumn("nutrition_pct", F.floor("nutrition_pct").cast("double"))


MINUTES_SQL = "(CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 75 END)"


@query("req_time_limit", f"SELECT o_orderkey, {MINUTES_SQL} AS minutes FROM orders WHERE {MINUTES_SQL} IS NULL OR {MINUTES_SQL} <= 30")
def req_time_limit(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.when(k % 6 > 0, k % 75).alias("minutes")).filter(F.col("minutes").isNull() | (F.col("minutes") <= 30))


WORDS_SQL = "(SELECT DISTINCT l_orderkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) JOIN lineitem ON l_partkey = p_partkey)"


def words(spark, d):
    w = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.explode(F.split("p_name", " ")).alias("word"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(w, "l_partkey").select("l_orderkey", "word").distinct()


def terms(spark, names):
    return spark.createDataFrame([(x,) for x in names], "term string")


@query(
    "req_exclude_terms",
    f"""
WITH t(term) AS (VALUES ('anv'), ('hot'), ('plat')), h AS (SELECT DISTINCT l_orderkey, word FROM {WORDS_SQL} JOIN t ON contains(word, term))
SELECT o_orderkey, count(word) = 0 AS passed, coalesce(array_to_string((list(word ORDER BY word) FILTER (word IS NOT NULL))[1:3], ','), '') AS hits FROM orders LEFT JOIN h ON l_orderkey = o_orderkey GROUP BY 1""",
)
def req_exclude_terms(spark, d):
    hits = op.term_hits(words(spark, d), terms(spark, ["anv", "hot", "plat"]), "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.slice(F.array_sort(F.collect_set("word")), 1, 3).alias("w"))
    return table(spark, d, "orders").select("o_orderkey").join(hits, "o_orderkey", "left").select("o_orderkey", F.col("w").isNull().alias("passed"), F.coalesce(F.array_join("w", ","), F.lit("")).alias("hits"))


@query(
    "req_include_terms",
    f"""
WITH t(term) AS (VALUES ('bolt'), ('red')), h AS (SELECT DISTINCT l_orderkey, term FROM {WORDS_SQL} JOIN t ON contains(word, term))
SELECT o_orderkey, count(h.term) = 2 AS passed, coalesce(string_agg(h.term, ',' ORDER BY h.term), '') AS found FROM orders LEFT JOIN h ON l_orderkey = o_orderkey GROUP BY 1""",
)
def req_include_terms(spark, d):
    need = ["bolt", "red"]
    hits = op.term_hits(words(spark, d), terms(spark, need), "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("term")).alias("t"))
    rows = table(spark, d, "orders").select("o_orderkey").join(hits, "o_orderkey", "left")
    return rows.select("o_orderkey", (F.coalesce(F.size("t"), F.lit(0)) == len(need)).alias("passed"), F.coalesce(F.array_join("t", ","), F.lit("")).alias("found"))


DIETS = [("vegan", "ring"), ("vegan", "gizmo"), ("nut_free", "anvil")]


@query(
    "req_dietary_tags",
    f"WITH t(tag, term) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in DIETS)}), h AS (SELECT DISTINCT l_orderkey, tag, word FROM {WORDS_SQL} JOIN t ON contains(word, term)) SELECT l_orderkey, tag, count(*) AS violations, array_to_string(list(word ORDER BY word)[1:2], ',') AS examples FROM h GROUP BY 1, 2",
)
def req_dietary_tags(spark, d):
    tags = spark.createDataFrame(DIETS, "tag string, term string")
    hits = op.term_hits(words(spark, d), tags, "l_orderkey").join(F.broadcast(tags), "term")  # three terms
    g = hits.groupBy("l_orderkey", "tag").agg(F.array_sort(F.collect_set("word")).alias("w"))
    return g.select("l_orderkey", "tag", F.size("w").cast("long").alias("violations"), F.array_join(F.slice("w", 1, 2), ",").alias("examples"))


MEAL = "CASE doc_id % 4 WHEN 0 THEN 'Lunch' WHEN 1 THEN 'snack' WHEN 2 THEN 'tea' END"
METADATA = "concat(text, case doc_id % 5 when 0 then ' a Soup, gluten free' when 1 then ' bite, Low-Carb' when 2 then ' nut_free' else '' end)"
MEAL_HIT = "CASE lower(" + MEAL + ") " + " ".join(f"WHEN '{m}' THEN regexp_matches(t, '{'|'.join(w)}')" for m, w in op.MEAL_WORDS.items()) + " END"


@query(
    "req_metadata_confidence",
    f"""
WITH d AS (SELECT doc_id, lower({METADATA}) AS t, CASE doc_id % 3 WHEN 0 THEN ['gluten_free', 'low_carb'] WHEN 1 THEN ['nut_free'] ELSE [] END AS tags FROM documents),
s AS (SELECT doc_id, list_concat(CASE WHEN {MEAL_HIT} THEN [0.9] WHEN NOT {MEAL_HIT} THEN [0.3] ELSE [] END::DOUBLE[], list_transform(tags, lambda x: CASE WHEN contains(t, replace(x, '_', ' ')) OR contains(t, replace(x, '_', '-')) OR contains(t, x) THEN 0.95 ELSE 0.4 END)::DOUBLE[]) AS s FROM d)
SELECT doc_id, round(CASE WHEN len(s) = 0 THEN 0.5 ELSE list_sum(s) / len(s) END, 9) AS confidence FROM s""",
)
def req_metadata_confidence(spark, d):
    tags = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("gluten_free"), F.lit("low_carb"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("nut_free")))
    return table(spark, d, "documents").select("doc_id", F.round(op.metadata_confidence(F.expr(METADATA), F.expr(MEAL), tags), 9).alias("confidence"))


@query(
    "req_verify_all",
    f"""
WITH h AS (SELECT DISTINCT l_orderkey FROM {WORDS_SQL} WHERE contains(word, 'anv'))
SELECT o.o_orderkey, coalesce(nutrition_ok AND ({MINUTES_SQL} IS NULL OR {MINUTES_SQL} <= 30) AND h.l_orderkey IS NULL, false) AS exact, floor(coalesce(nutrition_pct, 0)) AS pct
FROM orders o LEFT JOIN {NUTRITION_SQL} n ON n.l_orderkey = o.o_orderkey LEFT JOIN h ON h.l_orderkey = o.o_orderkey""",
)
def req_verify_all(spark, d):
    k = F.col("o_orderkey")
    bad = op.term_hits(words(spark, d), terms(spark, ["anv"]), "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("bad", F.lit(True))
    rows = table(spark, d, "orders").select("o_orderkey").join(nutrition(spark, d).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left").join(bad, "o_orderkey", "left")
    minutes = F.when(k % 6 > 0, k % 75)
    rows = rows.withColumns({"time_ok": minutes.isNull() | (minutes <= 30), "exclude_ok": F.col("bad").isNull()})
    return op.verify_all(rows, ["time_ok", "exclude_ok"], "nutrition_ok", "nutrition_pct").select("o_orderkey", "exact", F.floor(F.coalesce("nutrition_pct", F.lit(0.0))).cast("double").alias("pct"))


#: What customers ask for, by the customer's number, as documents.
DOCUMENTS = [
    '{"subject": "cheesecake", "dietary_constraints": ["vegan", "paleo"], "nutrition_requirements": ["min_protein_20g", "protein"]}',
    '{"subject": "cake", "allergy_constraints": ["nuts", "pollen"], "time_constraints": "quick"}',
    '{"subject": "Chicken Soup", "dietary_constraints": ["gluten-free", "dairy-free", "keto"], "nutrition_requirements": ["max_calories_300", "30g protein"]}',
    '{"allergy_constraints": ["eggs", "shellfish"], "time_constraints": "under_25_minutes"}',
    '{"dietary_constraints": ["carnivore"], "time_constraints": "soon"}',
    '{"subject": "", "dietary_constraints": [], "time_constraints": ""}',
    '{"subject": "pasta", "nutrition_requirements": ["max_calories_450", "max_calories_450"]}',
]
DOCUMENT = f"CASE c_custkey % {len(DOCUMENTS)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(DOCUMENTS)) + " END"
#: Recipes of orders: titles, and lines of ingredients that the parts stand for.
TITLE = "CASE o_orderkey % 8 WHEN 0 THEN 'Classic Cheesecake' WHEN 1 THEN 'Chocolate Fudge' WHEN 2 THEN 'Creamy CHICKEN Soup' WHEN 3 THEN 'Pasta al Forno' WHEN 4 THEN 'Green Salad' WHEN 5 THEN 'Soup of Chicken' WHEN 6 THEN '' END"
FOOD_LINE = "CASE l_partkey % 16 WHEN 0 THEN 'wheat flour' WHEN 1 THEN '2 Eggs' WHEN 2 THEN 'almond milk' WHEN 3 THEN 'shrimps' WHEN 4 THEN 'rice' WHEN 5 THEN 'doughnut' WHEN 6 THEN 'chicken stock' ELSE p_name END"
NUTRITION = "CASE o_orderkey % 5 WHEN 0 THEN {a}('Energy 400 kcal', 'Protein: ', 'protein 25.5 g') WHEN 1 THEN {a}('Calories 280', 'Protein 18g') WHEN 2 THEN {a}('Fat 3 g') WHEN 3 THEN {a}('calories 450 kcal', '31 g Protein') END"
COOK_TIME = "CASE o_orderkey % 4 WHEN 0 THEN concat('PT', cast(o_orderkey % 60 as {s}), 'M') WHEN 1 THEN concat(cast(o_orderkey % 45 as {s}), ' minutes') WHEN 2 THEN '' END"
PRIORITY = ["allrecipes.com", "food52.com"]
SITE = "CASE o_orderkey % 3 WHEN 0 THEN 'https://www.allrecipes.com/r' WHEN 1 THEN 'http://blog.food52.com/x' ELSE 'https://example.org/' END"


def _flags_sql():
    """Every rule of every document, written down; contained terms by whole texts."""
    has = lambda text, *terms: "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"
    vegan = has("i", "chicken", "beef", "pork", "fish", "egg", "milk", "cheese", "butter")
    rules = [
        {"subject_match": has("t", "cheesecake"), "vegan": f"NOT {vegan}", "min_20g_protein": "protein >= 20"},
        {"subject_match": has("t", "cake", "chocolate"), "nuts_excluded": f"NOT {has('i', 'nut', 'almond', 'walnut', 'pecan', 'cashew', 'peanut')}", "quick": "minutes <= 30"},
        {"subject_match": f"({has('t', 'chicken soup')} OR {has('i', 'chicken soup')})", "gluten_free": f"NOT {has('i', 'flour', 'wheat', 'bread', 'pasta')}", "dairy_free": f"NOT {has('i', 'milk', 'cheese', 'butter', 'cream', 'yogurt')}",
         "keto": f"NOT {has('i', 'flour', 'sugar', 'bread', 'pasta', 'rice')}", "max_300_calories": "calories <= 300", "min_30g_protein": "protein >= 30"},
        {"eggs_excluded": f"NOT {has('i', 'egg')}", "shellfish_excluded": f"NOT {has('i', 'shrimp', 'crab', 'lobster', 'shellfish')}", "under_25_minutes": "minutes <= 25"},
        {},
        {"no_constraints": "true"},
        {"subject_match": f"({has('t', 'pasta')} OR {has('i', 'pasta')})", "max_450_calories": "calories <= 450"},
    ]
    rows = " UNION ALL ".join(f"SELECT o_custkey, o_orderkey, '{flag}' AS flag, coalesce({test}, false) AS met FROM r WHERE o_custkey % {len(DOCUMENTS)} = {k}" for k, flags in enumerate(rules) for flag, test in flags.items())
    number = lambda names: rf"try_cast(nullif(regexp_extract(list_filter(n, lambda x: regexp_matches(lower(x), '{names}') AND regexp_matches(x, '\d'))[1], '(\d+)', 1), '') AS INTEGER)"
    return rf"""
WITH g AS (SELECT l_orderkey AS o_orderkey, lower(string_agg({FOOD_LINE}, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS i FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
r AS (SELECT o_custkey, o_orderkey, lower(coalesce({TITLE}, '')) AS t, coalesce(i, '') AS i, {number('protein')} AS protein, {number('calorie|kcal')} AS calories, try_cast(nullif(regexp_extract({COOK_TIME.format(s='VARCHAR')}, '(\d+)', 1), '') AS INTEGER) AS minutes
  FROM (SELECT *, {NUTRITION.format(a='list_value')} AS n FROM orders) LEFT JOIN g USING (o_orderkey)),
f AS ({rows})"""


FLAGS_SQL = _flags_sql()


def customer_rules(spark, d):
    asked = spread(table(spark, d, "customer").select("c_custkey")).select(F.col("c_custkey").alias("o_custkey"), F.expr(DOCUMENT).alias("document"))
    return op.constraint_rules(asked, "o_custkey", "document")


def flags(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    named = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    texts = named.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(FOOD_LINE).alias("food")))).alias("i"))
    joined = texts.select("o_orderkey", F.array_join(F.transform("i", lambda x: x["food"]), " ").alias("ingredients"))
    recipes = o.select("o_orderkey", F.expr(TITLE).alias("title"), F.expr(NUTRITION.format(a="array")).alias("nutrition"), F.expr(COOK_TIME.format(s="string")).alias("cook_time")).join(joined, "o_orderkey", "left")
    return op.constraint_flags(o, recipes, customer_rules(spark, d), "o_custkey", "o_orderkey")


@query(
    "req_constraint_flags",
    FLAGS_SQL + f""", s AS (SELECT o_orderkey, string_agg(flag || '=' || met::VARCHAR, ';' ORDER BY flag) AS flags, round(100.0::DOUBLE * count(*) FILTER (met) / count(*), 1) AS a FROM f GROUP BY 1)
SELECT o_orderkey, coalesce(flags, '') AS flags, CASE WHEN flags = 'no_constraints=true' THEN NULL ELSE coalesce(a, 100.0) END AS accuracy,
 CASE WHEN o_orderkey % 3 < 2 THEN CASE WHEN o_orderkey % 4 > 0 THEN 100.0 ELSE 80.0 END WHEN o_orderkey % 4 > 0 THEN 60.0 ELSE 40.0 END::DOUBLE AS quality FROM r LEFT JOIN s USING (o_orderkey)""",
)
def req_constraint_flags(spark, d):
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("details"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))), ";")
    quality = op.listing_quality(domain(F.expr(SITE)), PRIORITY, F.col("o_orderkey") % 4 > 0)
    return flags(spark, d).select("o_orderkey", shown.alias("flags"), "accuracy", quality.alias("quality"))


QUERY_TEXT = "text || CASE turn % 6 WHEN 0 THEN ' Vegan with 30g protein' WHEN 1 THEN ' under 500 calories in 20 min' WHEN 2 THEN ' keto no nuts' WHEN 3 THEN ' 25 protein, Nut-Free' WHEN 4 THEN ' paleo, gluten-free and dairy-free, 300 Calorie' ELSE '' END"
FOUND_SQL = rf"""(SELECT conv_id, turn, unnest(list_filter([{', '.join(f"CASE WHEN contains(t, '{w}') THEN 'diet={w.replace('-', '_')}' END" for w in op.QUERY_DIETS)},
 'protein=' || nullif(regexp_extract(t, '(\d+)g?\s*protein', 1), ''), 'calories=' || nullif(regexp_extract(t, '(\d+)\s*calorie', 1), ''), 'minutes=' || nullif(regexp_extract(t, '(\d+)\s*min', 1), ''), 'exclude=' || nullif(regexp_extract(t, 'no\s+([\p{{L}}\p{{N}}_]+)', 1), '')], lambda x: x IS NOT NULL)) AS needed
 FROM (SELECT conv_id, turn, lower({QUERY_TEXT}) AS t FROM conversations WHERE role = 'user'))"""


def needed(spark, d):
    text = F.expr(QUERY_TEXT)
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.explode(op.from_query(text)).alias("needed"))


@query("req_extract_from_query", f"SELECT conv_id, turn, needed FROM {FOUND_SQL}")
def req_extract_from_query(spark, d):
    return needed(spark, d)


@query(
    "req_constraints_met",
    FLAGS_SQL + """, m AS (SELECT o_custkey, flag, bool_or(met) AS met FROM f WHERE flag <> 'no_constraints' GROUP BY 1, 2), z AS (SELECT o_custkey, count(*) AS identified, count(*) FILTER (met) AS satisfied FROM m GROUP BY 1)
SELECT c_custkey AS o_custkey, coalesce(identified, 0) AS identified, coalesce(satisfied, 0) AS satisfied, CASE WHEN identified > 0 THEN round(100.0::DOUBLE * satisfied / identified, 1) ELSE 100.0 END AS rate FROM customer LEFT JOIN z ON o_custkey = c_custkey""",
)
def req_constraints_met(spark, d):
    asked = flags(spark, d).filter("accuracy IS NOT NULL").select("o_custkey", F.explode("details").alias("constraint", "met"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return op.constraints_met(asked, "o_custkey", "constraint", "met", customers)


@query(
    "req_field_presence",
    """WITH r AS (SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS lines, CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 5 < 4 THEN source END AS image, (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (doc_id % 3 > 0)::INT + 1 AS n FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, array_to_string(list_filter([CASE WHEN lines = 0 THEN 'ingredients' END, CASE WHEN trim(coalesce(image, '')) = '' THEN 'image_url' END, CASE WHEN n < 4 THEN 'nutrition' END], lambda x: x IS NOT NULL), ',') AS missing FROM r""",
)
def req_field_presence(spark, d):
    k = F.col("doc_id")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    values = F.array_compact(F.array(F.col("quality"), F.col("toxic"), F.when(k % 3 > 0, 1), F.lit(1)))
    image = F.when(k % 5 == 0, " ").when(k % 5 < 4, F.col("source"))
    return records(spark, d).select("doc_id", F.array_join(op.missing_fields(lines, image, values), ",").alias("missing"))
