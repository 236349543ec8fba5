"""Queries: text columns to typed columns. Texts are generated from the tables, alike in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import texts as op
from larder.operators import units as op_units
from larder.plans.registry import query, table
from larder.plans.units import FOOD_SQL
from larder.sources import spread

#: An ingredient line of a recipe line, by its number.
LINE = """CASE l_linenumber WHEN 1 THEN concat(cast(l_partkey % 9 + 1 as {s}), ' cups of ', p_name) WHEN 2 THEN concat('1 1/2 tablespoons ', p_name, ', chopped') WHEN 3 THEN concat(cast(l_partkey % 5 + 1 as {s}), ' ', p_name)
 WHEN 4 THEN concat(cast(l_partkey % 400 + 50 as {s}), 'g ', p_name) WHEN 5 THEN concat('about 2-3 slices ', p_name) WHEN 6 THEN p_name ELSE concat('2 (14 oz) cans ', p_name, ', or 3 cups fresh') END"""
LINE_SQL = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_name, " + LINE.format(s="VARCHAR") + " AS line FROM lineitem JOIN part ON p_partkey = l_partkey)"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS_SQL = ", ".join(KEYS)

def lines(spark, d):
    """Dealt to all cores: the tests' tables have one row group, and the patterns cost more than the shuffle."""
    joined = spread(table(spark, d, "lineitem").select(*KEYS, "l_quantity")).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return joined.withColumn("line", F.expr(LINE.format(s="string")))


def fractions_sql(c):
    for sign, plain in op.UNICODE_FRACTIONS.items():
        c = f"replace({c}, '{sign}', '{plain}')"
    return c


LINE_RE = rf"^(\d+\s+[{op.SIGNS}]|[{op.SIGNS}]|\d+\s+\d+/\d+|\d+/\d+|\d*\.\d+|\d+)\s+([\p{{L}}\p{{N}}_]+)\s+(.+)$"
GOOD = f"(regexp_matches(line, '{LINE_RE}') AND lower(regexp_extract(line, '{LINE_RE}', 2)) IN ({', '.join(repr(u) for u in op.LINE_UNITS)}))"
#: The first line of a recipe is a text of two lines with a blank one between.
SPLIT_SQL = f"""(SELECT * EXCLUDE (line, parts), unnest(parts) AS line, unnest(range(0, len(parts)))::INTEGER AS pos FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN [line, '2 CUPS Water'] ELSE [trim(line)] END AS parts FROM {LINE_SQL}))"""
PARSED_SQL = f"""(SELECT *, CASE WHEN {GOOD} THEN {fractions_sql(f"regexp_extract(line, '{LINE_RE}', 1)")} ELSE '1' END AS quantity, CASE WHEN {GOOD} THEN lower(regexp_extract(line, '{LINE_RE}', 2)) ELSE 'count' END AS unit,
 CASE WHEN {GOOD} THEN trim(regexp_extract(line, '{LINE_RE}', 3)) ELSE line END AS name FROM {SPLIT_SQL})"""


def parsed_lines(spark, d):
    text = F.when(F.col("l_linenumber") == 1, F.concat("line", F.lit("\n  \n 2 CUPS Water"))).otherwise(F.col("line"))
    split = op.text_lines(lines(spark, d).withColumn("text", text).drop("line"), "text")
    return split.select(*KEYS, "pos", "line", op.ingredient_line("line").alias("p"))


@query("txt_ingredient_lines", f"SELECT {KEYS_SQL}, pos, quantity, unit, name, CASE WHEN quantity = '1' AND unit = 'count' AND name = line THEN 'whole_line' ELSE 'parsed' END AS parse_status FROM {PARSED_SQL}")
def txt_ingredient_lines(spark, d):
    status = F.when((F.col("p.quantity") == "1") & (F.col("p.unit") == "count") & (F.col("p.name") == F.col("line")), "whole_line").otherwise("parsed")
    return op.with_status(parsed_lines(spark, d), status).select(*KEYS, "pos", "p.*", "parse_status")


#: Rich lines, by the order's number.
RICH = """concat(case l_orderkey % 9 WHEN 0 THEN 'About ' WHEN 1 THEN '• 1 TO ' WHEN 2 THEN '2–' WHEN 3 THEN '1 and 1/2 ' WHEN 4 THEN '1-1/2 ' WHEN 5 THEN '~ ' WHEN 6 THEN '½ ' WHEN 7 THEN '' ELSE '1 (14 oz) ' END,
 CASE WHEN l_orderkey % 9 IN (0, 1, 2, 5, 7) THEN line WHEN l_orderkey % 2 = 0 THEN concat('Cups of ', p_name, ' (', p_name, ')') ELSE concat('can ', p_name) END)"""
RICH_SQL = rf"""(SELECT *, CASE WHEN starts_with(q2, '.') THEN '0' || q2 ELSE q2 END AS q FROM (SELECT *, regexp_replace(regexp_replace(q1, '^(\d+)(?: and |-)(\d+/\d+)$', '\1 \2'), '(?i) ?(?:-|–|to|or) ?', '-') AS q2 FROM (
 SELECT *, regexp_matches(t, '{op.RICH_LINE}') AS got, regexp_extract(t, '{op.RICH_LINE}', 1) AS about, regexp_extract(t, '{op.RICH_LINE}', 2) AS q1, regexp_extract(t, '{op.RICH_LINE}', 3) AS size, lower(regexp_extract(t, '{op.RICH_LINE}', 5)) AS u,
  CASE WHEN regexp_matches(t, '{op.RICH_LINE}') THEN regexp_extract(t, '{op.RICH_LINE}', 6) ELSE t END AS rest
 FROM (SELECT *, trim(regexp_replace({fractions_sql(f"regexp_replace(regexp_replace(trim({RICH.format()}), '^[^\\w\\d\\s{op.SIGNS}/.,~(-]+\\s*', ''), '(\\d) *([{op.SIGNS}])', '\\1 \\2', 'g')")}, '\s+', ' ', 'g')) AS t FROM {LINE_SQL}))))"""


@query(
    "txt_ingredient_rich",
    rf"""SELECT {KEYS_SQL}, CASE WHEN got THEN q ELSE '1' END AS quantity, CASE WHEN NOT got OR u = '' THEN 'count' ELSE coalesce(n, u) END AS unit, trim(regexp_replace(regexp_replace(rest, '\s*\([^)]*\)\s*', ' ', 'g'), '\s+', ' ', 'g')) AS name,
 regexp_extract(rest, '\(([^)]+)\)', 1) AS context, CASE WHEN NOT got THEN 'whole' WHEN size <> '' THEN 'sized' WHEN about <> '' THEN 'about' WHEN contains(q, '-') THEN 'range' WHEN contains(q, ' ') THEN 'mixed' WHEN u = '' THEN 'count' ELSE 'plain' END AS form
 FROM {RICH_SQL} LEFT JOIN (VALUES {', '.join(str(x) for x in op.UNIT_NAMES.items())}) AS m(f, n) ON f = u""",
)
def txt_ingredient_rich(spark, d):
    rich = lines(spark, d).select(*KEYS, F.expr(RICH.format()).alias("line"))
    return op.ingredient_rich(rich, "line").drop("line")


#: Lines with second measures, by the order's number.
MEASURED = """CASE l_orderkey % 8 WHEN 0 THEN concat('400g/14oz canned ', p_name, ' (sub frozen 1 3/4 cups)') WHEN 1 THEN concat('½ Cup ', p_name, ' or ', cast(l_partkey % 9 + 1 as {s}), ' tbs') WHEN 2 THEN concat('2 - 3 cups (', cast(l_partkey % 400 as {s}), ' Grams) ', p_name)
 WHEN 3 THEN concat(cast(l_partkey % 5 as {s}), '.5 lbs ', p_name, ', 1.5kg or 3 pounds') WHEN 4 THEN concat('250g/1pkg ', p_name, ' and 100g/4oz') WHEN 5 THEN concat('2 1/2 tsp ', p_name, ', 2 1/2 teaspoons') ELSE line END"""


def measures_sql(line):
    """A list of 'quantity unit' texts."""
    names = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in op.UNIT_NAMES.items()) + "}"
    shown = lambda q, u: rf"trim({q}) || ' ' || coalesce({names}[regexp_replace(lower(trim({u})), '\.$', '')], trim({u}))"
    found = []
    for pattern, pairs in op.MEASURES:
        groups = ", ".join(f"regexp_extract_all({line}, '(?i){pattern}', {g})" for pair in pairs for g in pair)
        found.append(f"flatten(list_transform(list_zip({groups}), lambda x: [{', '.join(shown(f'x[{2 * k + 1}]', f'x[{2 * k + 2}]') for k in range(len(pairs)))}]))")
    return f"flatten([{', '.join(found)}])"


@query(
    "txt_alternative_units",
    f"WITH a AS (SELECT {KEYS_SQL}, {measures_sql(MEASURED.format(s='VARCHAR'))} AS l FROM {LINE_SQL}) SELECT {KEYS_SQL}, array_to_string(list_transform(list_sort(list_transform(list_distinct(l), lambda x: list_position(l, x))), lambda i: l[i]), ';') AS mentions FROM a",
)
def txt_alternative_units(spark, d):
    mentions = F.transform(op.alternative_units(F.expr(MEASURED.format(s="string"))), lambda x: F.concat_ws(" ", x["quantity"], x["unit"]))
    return lines(spark, d).select(*KEYS, F.array_join(mentions, ";").alias("mentions"))


GLUED = """CASE p_partkey % 9 WHEN 0 THEN concat(cast(p_size as {s}), 'Tbsp. ', p_name) WHEN 1 THEN concat('½cup ', p_name, '  (8 oz)cream') WHEN 2 THEN concat('1/2Cup', upper(p_name)) WHEN 3 THEN concat(cast(p_size as {s}), 'large ', p_name, ' and 2jumbo eggs')
 WHEN 4 THEN concat('2 Tbspheavy ', p_name, ', 8ounces') WHEN 5 THEN '11/2cups garlic oz.' WHEN 6 THEN concat(cast(p_size as {s}), 'g', upper(p_name), '  ', cast(p_partkey % 7 as {s}), 'tbsp. oil') WHEN 7 THEN concat('1 ¾cups', upper(p_name), ' 3Lbs.Butter') ELSE concat(' 12 ', p_name, ' 10/3 cupsugar ') END"""
_U, _W = op.LONGEST, "[A-Z]|(?i:" + "|".join(op.GLUED_WORDS) + ")"


@query(
    "txt_spacing_repair",
    rf"""WITH a AS (SELECT p_partkey, regexp_replace(trim({GLUED.format(s='VARCHAR')}), '(?i)({_U})\.', '\1', 'g') AS t FROM part),
b AS (SELECT p_partkey, regexp_replace(regexp_replace(t, '(?i)([\d{op.ALL_SIGNS}])({_U}|{'|'.join(op.SIZE_WORDS)})', '\1 \2', 'g'), '\b((?i:{_U}))({_W})', '\1 \2', 'g') AS t FROM a)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(t, '(\w\))([a-z])', '\1 \2', 'g'), '\s+', ' ', 'g'), '\b(\d)(\d)/(\d+)', '\1 \2/\3', 'g')) AS repaired FROM b""",
)
def txt_spacing_repair(spark, d):
    return table(spark, d, "part").select("p_partkey", op.spacing_repair(F.expr(GLUED.format(s="string"))).alias("repaired"))


QTY = "CASE p_partkey % 10 WHEN 0 THEN concat(cast(p_size as {s}), '') WHEN 1 THEN concat(cast(p_size as {s}), ' 1/2') WHEN 2 THEN concat('1/', cast(p_size as {s})) WHEN 3 THEN concat(cast(p_size as {s}), '-', cast(p_size + 3 as {s})) WHEN 4 THEN concat('~', cast(p_size as {s}), '.5') WHEN 5 THEN concat(cast(p_size as {s}), '⅝') WHEN 6 THEN concat('about ', cast(p_size as {s}), ' 1/4 – ', cast(p_size + 1 as {s}), ' 3/4') WHEN 7 THEN '⅖' WHEN 8 THEN '.25' ELSE 'some' END"


def qty_sql(mode):
    ends = ["p_size + 3", "p_size + 1.75"] if mode == "max" else ["p_size + 1.5", "p_size + 1"]
    return f"CASE p_partkey % 10 WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5 WHEN 2 THEN 1::DOUBLE / p_size WHEN 3 THEN {ends[0]} WHEN 4 THEN p_size + 0.5 WHEN 5 THEN p_size + 0.625 WHEN 6 THEN {ends[1]} WHEN 7 THEN 0.4 WHEN 8 THEN 0.25 END::DOUBLE"


@query("txt_quantity_value", f"SELECT p_partkey, {qty_sql('max')} AS by_max, {qty_sql('midpoint')} AS by_midpoint, coalesce({qty_sql('max')}, 1.0) AS with_default FROM part")
def txt_quantity_value(spark, d):
    q = table(spark, d, "part").withColumn("q", F.expr(QTY.format(s="string")))
    return q.select("p_partkey", op.quantity_value("q", "max").alias("by_max"), op.quantity_value("q", "midpoint").alias("by_midpoint"), F.coalesce(op.quantity_value("q", "max"), F.lit(1.0)).alias("with_default"))


#: Every unit that is known, and one that isn't, in the case of a line's number.
UNIT_LIST = [*op.UNIT_NAMES, "Handful"]
UNIT_AT = "(l_partkey + l_suppkey) % {n}"


@query("txt_unit_normalise", f"SELECT {KEYS_SQL}, coalesce(t, lower(trim(raw))) AS unit FROM (SELECT *, ([{', '.join(repr(u) for u in UNIT_LIST)}])[1 + {UNIT_AT.format(n=len(UNIT_LIST))}] AS raw FROM lineitem) LEFT JOIN (VALUES {', '.join(str(x) for x in op.UNIT_NAMES.items())}) AS m(f, t) ON f = lower(raw)")
def txt_unit_normalise(spark, d):
    at = F.expr(UNIT_AT.format(n=len(UNIT_LIST))).cast("int")
    raw = F.get(F.array(*[F.lit(u) for u in UNIT_LIST]), at)
    cased = F.when(F.col("l_linenumber") % 2 == 0, F.upper(raw)).otherwise(F.concat(F.lit(" "), raw))
    return op.normalise_unit(table(spark, d, "lineitem").select(*KEYS, cased.alias("raw")), "raw").select(*KEYS, "unit")


NUT = """CASE p_partkey % 5 WHEN 0 THEN concat('Calories', cast(p_size * 30 as {s}), 'Protein', cast(p_size % 40 as {s}), 'gFat', cast(p_size * 3 as {s}), 'g|Fiber: 4g') WHEN 1 THEN concat(cast(p_size * 30 as {s}), ' kcal|', cast(p_size % 40 as {s}), '.5g protein|Total Fat: ', cast(p_size * 6 as {s}), ' g')
 WHEN 2 THEN concat('Nutrition facts|Amount per serving|Energy: ', cast(p_size * 9 as {s}), '|', cast(p_size as {s}), ' grams protein|Total Carbohydrates: ', cast(p_size as {s}), '|', cast(p_size as {s}), 'mg sodium') WHEN 3 THEN concat('Sugars ', cast(p_size as {s}), 'g|carbs:', cast(p_size as {s}), '|sodium: 250') ELSE '' END"""


def nutrition_sql():
    t = f"lower(replace({NUT.format(s='VARCHAR')}, '|', ' '))"
    for pattern, by in op.NUTRITION_CLEAN:
        t = f"regexp_replace({t}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    value = lambda p, lo, hi: f"CASE WHEN TRY_CAST(nullif(regexp_extract(t, '{p}', 1), '') AS DOUBLE) BETWEEN {lo} AND {hi} THEN TRY_CAST(regexp_extract(t, '{p}', 1) AS DOUBLE) END"
    columns = [f"coalesce({', '.join(value(p, lo, hi) for p in patterns)}) AS {name}" for name, (lo, hi, patterns) in op.NUTRIENTS.items()]
    return f"SELECT p_partkey, {', '.join(columns)} FROM (SELECT p_partkey, {t} AS t FROM part)"


@query("txt_nutrition_values", nutrition_sql())
def txt_nutrition_values(spark, d):
    values = op.nutrition_values(F.split(F.expr(NUT.format(s="string")), r"\|"))
    return spread(table(spark, d, "part")).select("p_partkey", *values)


DUR = "CASE o_orderkey % 10 WHEN 0 THEN concat('PT', cast(o_orderkey % 5 as {s}), 'H', cast(o_orderkey % 60 as {s}), 'M') WHEN 1 THEN concat(cast(o_orderkey % 4 as {s}), ' hours ', cast(o_orderkey % 50 as {s}), ' minutes') WHEN 2 THEN cast(o_orderkey % 90 as {s}) WHEN 3 THEN concat(cast(o_orderkey % 3 + 1 as {s}), ' hr') WHEN 4 THEN concat(cast(o_orderkey % 45 as {s}), ' min') WHEN 5 THEN 'soon' WHEN 6 THEN concat(cast(o_orderkey % 7 as {s}), '.5 Hours') WHEN 7 THEN concat('P1DT', cast(o_orderkey % 9 as {s}), 'H') WHEN 8 THEN concat('PT', cast(o_orderkey % 500 as {s}), 'S') ELSE concat('ready in ', cast(o_orderkey % 30 as {s})) END"
DUR_SQL = "CASE o_orderkey % 10 WHEN 0 THEN (o_orderkey % 5) * 60 + o_orderkey % 60 WHEN 1 THEN (o_orderkey % 4) * 60 + o_orderkey % 50 WHEN 2 THEN o_orderkey % 90 WHEN 3 THEN (o_orderkey % 3 + 1) * 60 WHEN 4 THEN o_orderkey % 45 WHEN 6 THEN (o_orderkey % 7) * 60 + 30 WHEN 7 THEN 1440 + (o_orderkey % 9) * 60 WHEN 8 THEN (o_orderkey % 500) // 60 WHEN 9 THEN o_orderkey % 30 END::INTEGER"


@query("txt_duration_minutes", f"SELECT o_orderkey, {DUR_SQL} AS minutes, coalesce({DUR_SQL}, 10 + (o_orderkey % 20)::INTEGER) AS ready, CASE WHEN o_orderkey % 10 = 5 THEN 'rejected' ELSE 'parsed' END AS parse_status FROM orders")
def txt_duration_minutes(spark, d):
    minutes = op.duration_minutes(F.expr(DUR.format(s="string")))
    o = table(spark, d, "orders").select("o_orderkey", minutes.alias("minutes"))
    ready = F.coalesce("minutes", F.lit(10) + (F.col("o_orderkey") % 20).cast("int"))
    return op.with_status(o.withColumn("ready", ready), F.when(F.col("minutes").isNull(), "rejected").otherwise("parsed"))


#: A text with a title line and numbered steps, one of them empty; every ninth one is blank.
NUMBERED = "CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE concat(' ', source, chr(10), chr(10), '1. ', replace(text, chr(10), concat(chr(10), '2.')), chr(10), '3.') END"


@query(
    "txt_directions_steps",
    rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce({NUMBERED}, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
t AS (SELECT doc_id, coalesce(s[1], 'Untitled Recipe') AS title, list_filter(list_transform(s[2:], lambda x: regexp_replace(regexp_replace(x, '^\d+\.\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM l)
SELECT doc_id, title, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE range(0, len(s)) END)::INTEGER AS pos, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END) AS step FROM t""",
)
def txt_directions_steps(spark, d):
    parsed = table(spark, d, "documents").select("doc_id", op.directions(F.expr(NUMBERED)).alias("r"))
    return parsed.select("doc_id", "r.title", F.posexplode_outer("r.steps").alias("pos", "step"))


MAP = "concat('Step1:I', cast(o_orderkey % 7 as {s}), ',I', cast(o_orderkey % 5 as {s}), '|Step2:', case when o_orderkey % 3 = 0 then '?' else 'I9' end, '|junk|META_1:I', cast(o_orderkey % 11 as {s}))"


@query(
    "txt_mapping_decode",
    "SELECT o_orderkey, 'Step1' AS step, 'I' || (o_orderkey % 7)::VARCHAR AS item FROM orders UNION ALL SELECT o_orderkey, 'Step1', 'I' || (o_orderkey % 5)::VARCHAR FROM orders UNION ALL SELECT o_orderkey, 'Step2', 'I9' FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 'META_1', 'I' || (o_orderkey % 11)::VARCHAR FROM orders",
)
def txt_mapping_decode(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.inline(op.mapping_rows(F.expr(MAP.format(s="string")))))


SUSPECT_SQL = rf"quantity = '1' AND unit = 'count' AND (regexp_matches(name, '\d') OR {' OR '.join(f"contains(lower(name), '{u}')" for u in op.SUSPECT_UNITS)})"


@query("txt_suspect_parses", f"SELECT count(*) FILTER ({SUSPECT_SQL}) AS n, round(count(*) FILTER ({SUSPECT_SQL})::DOUBLE / count(*), 6) AS rate FROM {PARSED_SQL}")
def txt_suspect_parses(spark, d):
    p = parsed_lines(spark, d)
    bad = F.count_if(op.suspect_parse(F.col("p.quantity"), F.col("p.unit"), F.col("p.name")))
    return p.agg(bad.alias("n"), F.round(bad / F.count(F.lit(1)), 6).alias("rate"))


PHRASED = "CASE l_orderkey % 6 WHEN 0 THEN concat(p_name, ', Softened') WHEN 1 THEN concat(p_name, ' to taste') WHEN 2 THEN concat(p_name, ' if desired') WHEN 3 THEN concat(p_name, ' or oil') WHEN 4 THEN concat('preferably ', p_name) ELSE line END"


@query("txt_complexity_label", rf"SELECT {KEYS_SQL}, length(t) > 30 OR {' OR '.join(f"contains(lower(t), '{p}')" for p in op.COMPLEX_PHRASES)} AS is_complex FROM (SELECT *, {PHRASED} AS t FROM {LINE_SQL})")
def txt_complexity_label(spark, d):
    return lines(spark, d).select(*KEYS, op.complex_line(F.expr(PHRASED)).alias("is_complex"))


NEGLIGIBLE_UNIT = "CASE l_linenumber WHEN 1 THEN 'tsp' WHEN 2 THEN 'Tablespoons' WHEN 3 THEN 'count' WHEN 4 THEN 'Pinch' WHEN 5 THEN '' ELSE 'cup' END"
NEGLIGIBLE_NAME = "CASE WHEN l_suppkey % 9 = 0 THEN concat('Zest of ', p_name) WHEN l_suppkey % 9 = 1 THEN concat('diced ', p_name) WHEN l_suppkey % 9 = 2 THEN 'Ice' ELSE {food} END"
STARTS_RE, QUANTITY_SQL = "|".join(op_units.NEGLIGIBLE_STARTS), "(l_quantity % 4)"


@query(
    "txt_negligible_flag",
    f"""WITH l AS (SELECT *, lower(trim({NEGLIGIBLE_NAME.format(food=FOOD_SQL)})) AS n, lower({NEGLIGIBLE_UNIT}) AS u FROM {LINE_SQL}), s(k) AS (VALUES {', '.join(f"('{x.replace(chr(39), chr(39) * 2)}')" for x in op_units.SEASONINGS)}),
h AS (SELECT DISTINCT n, true AS seasoning FROM (SELECT DISTINCT n FROM l) JOIN s ON contains(n, k) OR contains(k, n))
SELECT {KEYS_SQL}, n IN ({', '.join(repr(x) for x in op_units.NEGLIGIBLE_NAMES)}) OR regexp_matches(n, '^(?:{STARTS_RE})') OR u IN ({', '.join(repr(x) for x in op_units.NEGLIGIBLE_UNITS)})
 OR (coalesce(seasoning, false) AND ((u = 'tsp' AND {QUANTITY_SQL} <= 2) OR (u = 'tablespoons' AND {QUANTITY_SQL} <= 1) OR (u IN ('count', '') AND {QUANTITY_SQL} <= 2))) AS negligible FROM l LEFT JOIN h USING (n)""",
)
def txt_negligible_flag(spark, d):
    rows = lines(spark, d).select(*KEYS, F.expr(NEGLIGIBLE_NAME.format(food=FOOD_SQL)).alias("name"), F.expr(NEGLIGIBLE_UNIT).alias("unit"), (F.col("l_quantity") % 4).alias("quantity"))
    rows = op_units.with_facts(rows, op_units.name_facts(rows, op_units.dictionaries(spark), "name"), "name")
    return rows.select(*KEYS, op_units.negligible(F.col("name"), F.col("quantity"), F.col("unit"), F.col("seasoning")).alias("negligible"))


@query("txt_name_clean", r"SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace(lower(trim(p_brand || '  Inc ' || p_type)), '\b(?:inc|promo|small)\b', '', 'g'), '\s+', ' ', 'g')), '') AS brand FROM part")
def txt_name_clean(spark, d):
    return table(spark, d, "part").select("p_partkey", op.clean_name(F.concat("p_brand", F.lit("  Inc "), "p_type"), ["inc", "promo", "small"]).alias("brand"))


SETS_TEXT = "concat(text, ' 2 cups Chopped Onion 1.5 and 3/4 tbsp')"
NO_WORD = r"[^\p{L}\p{N}_]"
#: A measure ends at a character that the next one needs before it, so every second one goes in a second pass.
NO_MEASURE = rf"'(^|{NO_WORD})\d+(?:/\d+)?\s*{op.MEASURE}($|{NO_WORD})', '\1\2', 'g'"


@query(
    "txt_word_set",
    rf"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower({SETS_TEXT}), {NO_MEASURE}), {NO_MEASURE}), '\d+(?:\.\d+)?', '', 'g'), '{NO_WORD}+'), lambda w: regexp_full_match(w, '[a-z]+') AND length(w) > 2 AND w NOT IN ({', '.join(repr(x) for x in [*op.STOP_WORDS, *op.DESCRIPTORS])})))), ' ') AS words FROM documents",
)
def txt_word_set(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(op.word_set(F.expr(SETS_TEXT))), " ").alias("words"))


#: Links as pages have them: relative ones, other quoting and order, tags in labels, lists, and what isn't a recipe.
ANCHORS = """CASE page_id % 6 WHEN 0 THEN '<A class=x HREF=''../recipe/soup-1/''>Tomato <b>soup</b></A><a href="mailto:x@y">Write to us</a>' WHEN 1 THEN '<a title="a" href = "best-recipe.html?x=1&amp;y=2"> Plum &amp; pie </a><a href=./salad-recipe>Salad</a>'
 WHEN 2 THEN '<a href="//cdn.example.org/recipes/ham">Hams and more</a><a href="/recipes/collection/x">Collections</a>' WHEN 3 THEN '<a href="https://other.example.net/2024/05/cake">Cakes and pies</a><a href="/recipe/egg">Egg</a><a name="x">No link at all</a>' WHEN 4 THEN '<a href="?recipe?=1">Question</a><a href="/recipes/17/dinner/">Dinners</a>' ELSE '' END"""


@query(
    "txt_page_links",
    rf"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages), b AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS dir FROM p),
l AS (SELECT page_id, base || regexp_replace(dir, '[^/]+/$', '') || 'recipe/soup-1/' AS link, 'Tomato soup' AS label FROM b WHERE page_id % 6 = 0
 UNION ALL SELECT page_id, base || dir || 'best-recipe.html?x=1&y=2', 'Plum & pie' FROM b WHERE page_id % 6 = 1 UNION ALL SELECT page_id, base || dir || 'salad-recipe', 'Salad' FROM b WHERE page_id % 6 = 1
 UNION ALL SELECT page_id, split_part(url, '//', 1) || '//cdn.example.org/recipes/ham', 'Hams and more' FROM b WHERE page_id % 6 = 2 UNION ALL SELECT page_id, 'https://other.example.net/2024/05/cake', 'Cakes and pies' FROM b WHERE page_id % 6 = 3
 UNION ALL SELECT page_id, base || path || '?recipe?=1', 'Question' FROM b WHERE page_id % 6 = 4
 UNION ALL SELECT page_id, base || unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 1)), unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 2)) FROM (SELECT page_id, html, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base FROM pages))
SELECT DISTINCT page_id, link, label FROM l WHERE length(label) >= 5 AND regexp_matches(lower(link), '{'|'.join([*op.RECIPE_URLS, '/th', 'in[gn]'])}') AND NOT regexp_matches(lower(link), '{'|'.join([*op.LIST_URLS, *op.OTHER_URLS, *op.CATEGORY_URLS])}')""",
)
def txt_page_links(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.concat(F.expr(ANCHORS), "html").alias("html"))
    return op.page_links(pages, "page_id", "url", "html", [*op.RECIPE_URLS, "/th", "in[gn]"])


#: JSON-LD blocks, since the pages have none: all shapes of type, instructions, yield and image, and what is dropped.
BLOCKS = [
    """'<script type="application/ld+json">{"@type":"Recipe","name":"dish ',{k},'","recipeIngredient":["salt","egg',{k},'"],"recipeInstructions":["mix","bake"],"totalTime":"PT20M","cookTime":"PT9M","prepTime":"PT5M","recipeYield":"4 servings","image":"http://i/',{k},'.jpg","nutrition":{"calories":"250 kcal","fatContent":"9 g"}}</script>'""",
    """'<script type="application/ld+json">[{"@type":"Article","name":"no","recipeIngredient":["x"]},{"@type":["Thing","Recipe"],"name":"second ',{k},'","recipeIngredient":["salt","egg',{k},'"],"recipeInstructions":[{"@type":"HowToStep","text":"first"},"second",{"name":"no text"}],"recipeYield":[6,"six"],"image":[{"url":"u',{k},'"}]}]</script>'""",
    """'<script type="application/ld+json">not json</script><script type="application/ld+json">{"@type":"Recipe","name":"","recipeIngredient":["x"]}</script>'""",
    """'<script type="application/ld+json">{"@type":"Article","name":"story ',{k},'","recipeIngredient":["x"]}</script>'""",
    """'<SCRIPT id=''z'' type = ''application/ld+json''> {"name":"third ',{k},'","recipeIngredient":["salt","egg',{k},'"],"@type":"Recipe","cookTime":"PT1H","yield":3,"image":{"url":"v',{k},'"},"recipeInstructions":"stir"} </SCRIPT>'""",
]


def block_expr(s):
    return "CASE page_id % 6 " + " ".join(f"WHEN {k + 1} THEN concat({b.replace('{k}', f'cast(page_id as {s})')})" for k, b in enumerate(BLOCKS)) + " ELSE '' END"


@query(
    "txt_page_jsonld",
    """SELECT page_id, (['dish ', 'second ', '', '', 'third '])[page_id % 6] || page_id::VARCHAR AS title, 'salt,egg' || page_id::VARCHAR AS ingredients, (['mix,bake', 'first,second', '', '', 'stir'])[page_id % 6] AS instructions, CASE page_id % 6 WHEN 1 THEN '250 kcal calories,9 g fat' ELSE '' END AS nutrition,
 (['PT20M', '', '', '', 'PT1H'])[page_id % 6] AS cook_time, CASE page_id % 6 WHEN 1 THEN 'PT5M' ELSE '' END AS prep_time, (['4 servings', '6', '', '', '3'])[page_id % 6] AS servings, CASE page_id % 6 WHEN 1 THEN 'http://i/' || page_id::VARCHAR || '.jpg' WHEN 2 THEN 'u' || page_id::VARCHAR ELSE 'v' || page_id::VARCHAR END AS image_url
FROM pages WHERE page_id % 6 IN (1, 2, 5)""",
)
def txt_page_jsonld(spark, d):
    out = op.page_jsonld(table(spark, d, "pages").select("page_id", F.concat(F.expr(block_expr("string")), "html").alias("html")), "page_id", "html")
    return out.withColumns({c: F.array_join(c, ",") for c in ("ingredients", "instructions", "nutrition")})
