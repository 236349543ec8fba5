"""Queries: unit conversion and macros per recipe."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import units as op
from larder.operators.lookups import nutrition_values, small
from larder.plans.lookups import DEFAULTS, MACROS, PORTION_SQL, TIERED_LINES_SQL, UNIT_SQL, line_unit, part_macros, portions, tiered_lines
from larder.plans.registry import query, table
from larder.sources import gathered

#: Foods that the part names stand for, so that the built-in dictionaries have something to find.
FOODS = {"small ring": "garlic", "red widget": "bell pepper", "blue bolt": "black pepper", "hot gear": "brown sugar", "old bolt": "eggplant", "hot ring": "sour cream", "new gear": "shiitake mushroom", "large widget": "sage"}
FOOD_SQL = "(CASE p_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FOODS.items()) + " ELSE p_name END)"
UNIT_ROWS = ", ".join(f"('{u}', '{kind}', {f})" for kind, us in (("weight", op.WEIGHT), ("tiny", op.TINY), ("volume", op.VOLUME)) for u, f in us.items())
QUOTED = [s.replace("'", "''") for s in op.SEASONINGS]
DICTIONARY_SQL = "(VALUES " + ", ".join([f"('density', {o}, '{k}', {float(v)})" for o, (k, v) in enumerate(op.DENSITY.items())] + [f"('piece', {o}, '{k}', {float(v)})" for o, (k, v) in enumerate(op.PIECE.items())] + [f"('seasoning', {o}, '{k}', 1.0)" for o, k in enumerate(QUOTED)]) + ") AS y(kind, o, k, v)"
#: Dictionaries meet distinct names only, in the SQL too.
FACTS_SQL = f"""(SELECT food, arg_min(v, o) FILTER (kind = 'density') AS density, arg_min(v, o) FILTER (kind = 'piece') AS piece, count(*) FILTER (kind = 'seasoning') > 0 AS seasoning
  FROM (SELECT DISTINCT {FOOD_SQL} AS food FROM part) LEFT JOIN {DICTIONARY_SQL} ON contains(food, k) OR (kind = 'seasoning' AND contains(k, food)) GROUP BY 1)"""
AMBIGUOUS_SQL = ", ".join(f"'{u}'" for u in op.AMBIGUOUS)
GRAMS_SQL = f"""(SELECT *, round(CASE WHEN kind IN ('weight', 'tiny') THEN l_quantity * factor WHEN kind = 'volume' AND portion IS NOT NULL THEN l_quantity * portion
   WHEN kind = 'volume' AND density IS NOT NULL THEN l_quantity * factor * density / 240 WHEN kind = 'volume' THEN l_quantity * factor WHEN u IN ({AMBIGUOUS_SQL}) AND seasoning THEN l_quantity
   WHEN u IN ('piece', 'count', 'clove') THEN l_quantity * coalesce(piece, 50.0) ELSE l_quantity * 100.0 END, 4)::DOUBLE AS grams,
   CASE WHEN kind IN ('weight', 'tiny') THEN kind WHEN kind = 'volume' AND portion IS NOT NULL THEN 'portion' WHEN kind = 'volume' AND density IS NOT NULL THEN 'density' WHEN kind = 'volume' THEN 'water'
   WHEN u IN ({AMBIGUOUS_SQL}) AND seasoning THEN 'seasoning' WHEN u IN ('piece', 'count', 'clove') AND piece IS NOT NULL THEN 'piece' WHEN u IN ('piece', 'count', 'clove') THEN 'piece_default' ELSE 'default' END AS gram_source
 FROM (SELECT x.*, regexp_replace(unit, 's$', '') AS u, {PORTION_SQL} AS portion, n.density, n.piece, n.seasoning, kind, factor FROM (SELECT *, {FOOD_SQL} AS food, {UNIT_SQL} AS unit FROM {TIERED_LINES_SQL}) x
   JOIN {FACTS_SQL} n USING (food) LEFT JOIN (VALUES {UNIT_ROWS}) AS t(un, kind, factor) ON un = regexp_replace(unit, 's$', '')))"""
WATER_SQL = f"(SELECT * REPLACE (CASE WHEN gram_source = 'water' AND est BETWEEN 10 AND 500 THEN est ELSE grams END AS grams, CASE WHEN gram_source = 'water' AND est BETWEEN 10 AND 500 THEN 'estimate' ELSE gram_source END AS gram_source) FROM (SELECT g.*, CASE WHEN l_partkey % 4 = 1 THEN (l_partkey % 600)::DOUBLE END AS est FROM {GRAMS_SQL} g))"
#: Negligible lines weigh nothing, whatever the override says.
NEGLIGIBLE_SQL = f"""(food IN ({', '.join(repr(x) for x in op.NEGLIGIBLE_NAMES)}) OR regexp_matches(food, '^(?:{'|'.join(op.NEGLIGIBLE_STARTS)})') OR lower(unit) IN ({', '.join(repr(x) for x in op.NEGLIGIBLE_UNITS)})
 OR (seasoning AND ((unit = 'tablespoon' AND l_quantity <= 1) OR (unit = 'piece' AND l_quantity <= 2))))"""
WEIGHED_SQL = f"(SELECT * REPLACE (CASE WHEN {NEGLIGIBLE_SQL} THEN 0.0 ELSE grams END AS grams, CASE WHEN {NEGLIGIBLE_SQL} THEN 'negligible' ELSE gram_source END AS gram_source) FROM {WATER_SQL})"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def food():
    return F.expr(FOOD_SQL)


def foods(spark, d):
    """Each part with its food name and what the dictionaries say of it; the dictionaries meet the parts' distinct names. Where few
    names have facts, parts aren't brought together by name."""
    named = part_macros(spark, d).withColumn("food", food())
    return op.with_facts(named, small(op.name_facts(named, op.dictionaries(spark), "food")), "food")


def lines_in_grams(spark, d):
    """Recipe lines with values per 100 g and grams. All that depends on the ingredient is resolved on the ingredients, so the
    lines meet one join. A task of it holds its share of the ingredients, which are distinct, and lets the lines pass unsorted."""
    p = foods(spark, d)
    reference = p.filter("l_partkey % 3 = 0")
    estimates = p.filter("l_partkey % 3 = 1").select("l_partkey", *[(F.col(m) / 2).alias(m) for m in MACROS])
    known = nutrition_values(p.select("l_partkey", "food", "density", "piece", "seasoning"), reference, estimates, "l_partkey", MACROS, DEFAULTS)
    guess = table(spark, d, "part").filter("p_partkey % 4 = 1").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 600).cast("double").alias("guess"))
    lines = table(spark, d, "lineitem").select(*KEYS, "l_quantity").join(known.join(guess, "l_partkey", "left").hint("shuffle_hash"), "l_partkey")
    g = op.grams(F.col("l_quantity"), line_unit(), portions(), F.col("density"), F.col("piece"), F.col("seasoning"))
    return lines.withColumn("_g", g).select(*KEYS, *MACROS, "guess", "food", "seasoning", "l_quantity", "_g.grams", "_g.gram_source")


@query("cnv_to_grams", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, grams, gram_source FROM {GRAMS_SQL}")
def cnv_to_grams(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), food().alias("food")), "l_partkey").withColumns({"unit": line_unit(), "portions": portions()})
    names = table(spark, d, "part").select(food().alias("food"))
    return op.to_grams(lines, op.dictionaries(spark), "l_quantity", "unit", "food", names=names).select(*KEYS, "grams", "gram_source")


@query("cnv_override_water", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(grams, 4) AS grams, gram_source, round(calories * grams / 100, 9) AS calories FROM {WATER_SQL}")
def cnv_override_water(spark, d):
    lines = op.overridden(lines_in_grams(spark, d), F.col("guess"))
    return lines.select(*KEYS, F.round("grams", 4).alias("grams"), "gram_source", F.round(F.col("calories") * F.col("grams") / 100, 9).alias("calories"))


@query(
    "cnv_reference_sanity",
    """
WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 > 1 THEN p_retailprice WHEN p_partkey % 4 = 1 THEN 0.0 END AS kcal, (p_size % 30)::DOUBLE AS protein, (p_size % 50 * 3)::DOUBLE AS fat, (p_size % 40)::DOUBLE AS carbs FROM part),
c AS (SELECT *, CASE WHEN coalesce(kcal, 0) = 0 AND (fat > 0 OR protein > 0 OR carbs > 0) THEN round(9 * fat + 4 * protein + 4 * carbs, 1) ELSE coalesce(kcal, 0) END AS calories FROM p)
SELECT p_partkey, calories, NOT (carbs > 105 OR fat > 105 OR protein > 105 OR calories > 950) AND NOT (calories = 0 AND fat = 0 AND protein = 0 AND carbs = 0 AND NOT regexp_matches(lower(p_name), 'salt|water')) AS sane FROM c""",
)
def cnv_reference_sanity(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    kcal = F.when(k % 4 > 1, F.col("p_retailprice")).when(k % 4 == 1, 0.0)
    p = table(spark, d, "part").select("p_partkey", "p_name", kcal.alias("calories"), (s % 30).cast("double").alias("protein"), (s % 50 * 3).cast("double").alias("fat"), (s % 40).cast("double").alias("carbs"))
    return op.reference_sanity(p, "p_name").select("p_partkey", "calories", "sane")


def weighed(spark, d, *columns):
    """These columns of the weighed lines, those of a recipe in one task; the lines are counted from the files' footers."""
    lines = lines_in_grams(spark, d)
    flag = op.negligible(F.col("food"), F.col("l_quantity"), line_unit(), F.col("seasoning"))
    rows = op.without_negligible(op.overridden(lines, F.col("guess")), flag).select("l_orderkey", *columns)
    return gathered(rows, "l_orderkey", table(spark, d, "lineitem").count())


@query("agg_recipe_macros", f"SELECT l_orderkey, {', '.join(f'round_even(sum({m}::DECIMAL(10, 2) * grams::DECIMAL(14, 4))::DOUBLE / 100, 0) AS {m}' for m in MACROS)} FROM {WEIGHED_SQL} GROUP BY 1")
def agg_recipe_macros(spark, d):
    """Macros per recipe: reference values, grams with the water override, nothing for negligible lines, one sum per recipe."""
    return weighed(spark, d, "grams", *MACROS).groupBy("l_orderkey").agg(*[op.rounded_total(m).alias(m) for m in MACROS])


@query(
    "agg_source_mix",
    f"""
WITH s AS (SELECT l_orderkey, CASE {' '.join(f"WHEN gram_source IN ({', '.join(repr(k) for k in kinds)}) THEN {o}" for o, kinds in enumerate(op.PROVENANCE.values()))} END AS o, count(*) AS n FROM {WEIGHED_SQL} GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS total FROM s)
SELECT l_orderkey, string_agg(({list(op.PROVENANCE)})[o + 1] || ':' || round_even(100.0::DOUBLE * n / total, 0)::INTEGER::VARCHAR || '%', ',' ORDER BY o) AS mix FROM t GROUP BY 1""",
)
def agg_source_mix(spark, d):
    return op.source_mix(weighed(spark, d, "gram_source"), "l_orderkey")
