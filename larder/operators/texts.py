"""Text columns to typed columns. All rules are native expressions; each job can also report its rejects by status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import col
from larder.operators.lookups import small

# Units that an ingredient line may have, and the names they are given. A unit that isn't listed stays as it is.
UNIT_NAMES = {
    "c": "cup", "cup": "cup", "cups": "cup", "tbsp": "tablespoon", "tbs": "tablespoon", "tb": "tablespoon", "tablespoon": "tablespoon", "tablespoons": "tablespoon",
    "tsp": "teaspoon", "t": "teaspoon", "ts": "teaspoon", "tspn": "teaspoon", "teaspoon": "teaspoon", "teaspoons": "teaspoon",
    "ml": "milliliter", "mls": "milliliter", "milliliter": "milliliter", "milliliters": "milliliter", "millilitres": "milliliter", "l": "liter", "liter": "liter", "liters": "liter", "litres": "liter",
    "pt": "pint", "pts": "pint", "pint": "pint", "pints": "pint", "qt": "quart", "qts": "quart", "quart": "quart", "quarts": "quart", "gal": "gallon", "gals": "gallon", "gallon": "gallon", "gallons": "gallon",
    "fl oz": "fluid ounce", "fl. oz": "fluid ounce", "fl. oz.": "fluid ounce", "oz": "ounce", "oz.": "ounce", "ounce": "ounce", "ounces": "ounce",
    "lb": "pound", "lbs": "pound", "lb.": "pound", "lbs.": "pound", "pound": "pound", "pounds": "pound", "g": "gram", "gs": "gram", "gram": "gram", "grams": "gram", "kg": "kilogram", "kgs": "kilogram", "kilogram": "kilogram", "kilograms": "kilogram",
    "piece": "piece", "pieces": "piece", "slice": "slice", "slices": "slice", "clove": "clove", "cloves": "clove", "bunch": "bunch", "bunches": "bunch", "head": "head", "heads": "head", "can": "can", "cans": "can",
    "jar": "jar", "jars": "jar", "package": "package", "packages": "package", "packet": "packet", "packets": "packet", "bag": "bag", "bags": "bag", "count": "count",
}
# Units of a plain line (quantity, unit, name), in lower case.
LINE_UNITS = [
    "cup", "cups", "tablespoon", "tablespoons", "tbsp", "teaspoon", "teaspoons", "tsp", "milliliter", "milliliters", "ml", "liter", "liters", "l", "pint", "pints", "quart", "quarts", "gallon", "gallons",
    "ounce", "ounces", "oz", "pound", "pounds", "lb", "lbs", "gram", "grams", "g", "kilogram", "kilograms", "kg", "piece", "pieces", "slice", "slices", "clove", "cloves", "bunch", "bunches", "head", "heads",
    "can", "cans", "jar", "jars", "package", "packages", "bag", "bags", "count",
]
# Units of a rich line, longer ones before those they begin with.
RICH_UNITS = [
    "tablespoons", "tablespoon", "tbsp", "tbs", "tb", "teaspoons", "teaspoon", "tspn", "tsp", "ts", "cups", "cup", "c", "gallons", "gallon", "gals", "gal", "pints", "pint", "pts", "pt", "quarts", "quart", "qts", "qt",
    "milliliters", "milliliter", "millilitres", "mls", "ml", "liters", "liter", "litres", "ounces", "ounce", "oz", "pounds", "pound", "lbs", "lb", "l", "grams", "gram", "gs", "g", "kilograms", "kilogram", "kgs", "kg",
    "cans", "can", "bunches", "bunch", "heads", "head", "cloves", "clove", "slices", "slice", "pieces", "piece", "packages", "package", "pkgs", "pkg", "jars", "jar", "bottles", "bottle", "bags", "bag", "each",
    "large", "medium", "small", "pinch", "dash",
]
# Fixed values.
UNICODE_FRACTIONS = {
    "½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅐": "1/7", "⅑": "1/9", "⅒": "1/10",
}
# Measures, descriptors and stop words that don't count as words of an ingredient.
MEASURE = r"(?:cups?|tbsp|tablespoons?|tsp|teaspoons?|oz|ounces?|lbs?|pounds?|g|grams?|kg|ml|liters?)"
DESCRIPTORS = ["fresh", "dried", "chopped", "minced", "sliced", "diced", "whole", "ground", "fine", "coarse", "large", "small", "medium", "shredded", "grated"]
STOP_WORDS = ["and", "or", "the", "a", "an", "of", "to", "for", "in", "as", "with"]
SIGNS = "".join(UNICODE_FRACTIONS)
NUMBER = r"\d+(?:\.\d+)?"
#: A mixed number, a fraction or a decimal.
TERM = r"(?:\d+ \d+/\d+|\d+/\d+|\d*\.\d+|\d+)"


def with_status(df: DataFrame, status: Column) -> DataFrame:
    return df.withColumn("parse_status", status)


def reject_rates(parsed: DataFrame) -> DataFrame:
    """Rows and rate per parse_status."""
    counts = parsed.groupBy("parse_status").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("parse_status", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


def plain_fractions(text: Column) -> Column:
    """Unicode fractions as `a/b`, a space before them where a digit stands. Texts without any are left as they are."""
    out = F.regexp_replace(text, rf"(\d) *([{SIGNS}])", "$1 $2")
    for sign, plain in UNICODE_FRACTIONS.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return F.when(text.rlike(f"[{SIGNS}]"), out).otherwise(text)


def _parts(text: Column, pattern: str, groups: str) -> Column:
    """The groups of a pattern that covers the whole text, as an array; of another size if it doesn't match. One search."""
    return F.split(F.regexp_replace(text, pattern, groups), "\x01")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _term(text: Column) -> Column:
    """Number of a mixed number, fraction or decimal; null if it is none."""

    def number(part: Column) -> Column:
        at = lambda k: F.nullif(F.get(part, F.lit(k)), F.lit("")).try_cast("double")
        value = F.coalesce(at(0), F.lit(0.0)) + F.when(F.get(part, F.lit(2)) == "", at(1)).otherwise(F.try_divide(at(1), at(2)))
        return F.when((F.size(part) == 3) & ((F.get(part, F.lit(0)) == "") | (F.get(part, F.lit(2)) != "")), value)

    return _let(_parts(text, r"^(?:(\d+) )?(\d*\.?\d+)(?:/(\d+))?$", "$1\x01$2\x01$3"), number)


def quantity_value(text: str | Column, mode: str) -> Column:
    """Number of a quantity text: whole, decimal, fraction, mixed number or a range of them (`max` or `midpoint`), after `~`, `≈` or
    "about"; null if it is none."""

    def value(t: Column, ends: Column) -> Column:
        low, high = _term(F.get(ends, F.lit(0))), _term(F.get(ends, F.lit(1)))
        return F.when(F.size(ends) == 2, F.greatest(low, high) if mode == "max" else (low + high) / 2).otherwise(_term(t))

    plain = _let(F.regexp_replace(col(text), "~|≈|about", ""), lambda x: F.trim(F.regexp_replace(plain_fractions(x), " +", " ")))
    return _let(plain, lambda t: _let(_parts(t, rf"^({TERM}) ?[-–] ?({TERM})$", "$1\x01$2"), lambda ends: value(t, ends)))


def text_lines(df: DataFrame, text: str) -> DataFrame:
    """`df` with a row per line of `text` that isn't blank: `line`, trimmed, and `pos`, its place among them."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select("*", F.posexplode(lines).alias("pos", "line"))


def ingredient_line(line: str | Column) -> Column:
    """Struct(quantity, unit, name): a number, a known unit (in lower case) and a name, else the whole line as one `count`.

    Numbers are whole, decimal, fractions, or mixed with a space; unicode fractions become `a/b`. No ranges."""
    t = F.trim(col(line))
    number = rf"\d+\s+[{SIGNS}]|[{SIGNS}]|\d+\s+\d+/\d+|\d+/\d+|\d*\.\d+|\d+"
    part = _parts(t, rf"^({number})\s+([\p{{L}}\p{{N}}_]+)\s+(.+)$", "$1\x01$2\x01$3")
    unit = F.lower(F.get(part, F.lit(1)))
    quantity = F.regexp_replace(plain_fractions(F.get(part, F.lit(0))), r"\s+", " ")
    good = (F.size(part) == 3) & unit.isin(LINE_UNITS)
    make = lambda q, u, n: F.struct(q.alias("quantity"), u.alias("unit"), n.alias("name"))
    return F.when(good, make(quantity, unit, F.trim(F.get(part, F.lit(2))))).otherwise(make(F.lit("1"), F.lit("count"), t))


#: Quantity of a rich line: range, mixed number ("1 1/2", "1 and 1/2", "1-1/2"), fraction, decimal or whole number.
RICH_QUANTITY = rf"(?:(?:{TERM}) ?(?:-|–|to|or) ?(?:\d+ \d+/\d+|\d+/\d+|{NUMBER})\b|\d+(?: and |-)\d+/\d+|{TERM})"
#: Groups: "about", quantity, size in brackets and its unit, unit, rest.
RICH_LINE = rf"(?i)^((?:about|roughly|around|approximately)\s+|~\s*)?({RICH_QUANTITY})\+?\s*(?:\(({NUMBER})[-– ]*({'|'.join(RICH_UNITS)})\.?\)\s*)?(?:({'|'.join(RICH_UNITS)})\b\.?)?\s*(?:of\s+)?(\S.*)$"


def ingredient_rich(lines: DataFrame, line: str) -> DataFrame:
    """`lines` with quantity, unit (by UNIT_NAMES), name, context and form.

    Bullets before the line are dropped. A line is an optional "about" or "~", a quantity, an optional size in brackets, an
    optional unit (glued to the number or not) and the rest; without a quantity it is one `count`. Ranges are written "a-b", mixed
    numbers "a b/c". The first text in brackets of the rest is the context and leaves the name. `form` says what was found: sized,
    about, range, mixed, count, plain or whole. One search per line finds all parts.
    """
    keep = [c for c in lines.columns if c not in {"quantity", "unit", "name", "context", "form"}]
    # a column of its own for what is used more than once, so that it is found once
    bare = lines.select(*keep, F.regexp_replace(F.trim(F.col(line)), rf"^[^\w\d\s{SIGNS}/.,~(-]+\s*", "").alias("_l"))
    cleaned = bare.select(*keep, F.trim(F.regexp_replace(plain_fractions(F.col("_l")), r"\s+", " ")).alias("_t"))
    parts = cleaned.withColumn("_p", _parts(F.col("_t"), RICH_LINE, "$1\x01$2\x01$3\x01$5\x01$6"))
    got = F.size("_p") == 5
    at = lambda k: F.get(F.col("_p"), F.lit(k))
    found = parts.select(*keep, got.alias("_got"), F.when(got, at(1)).alias("_q"), F.when(got, at(0)).alias("_about"), F.when(got, at(2)).alias("_size"), F.lower(F.when(got, at(3))).alias("_u"), F.when(got, at(4)).otherwise(F.col("_t")).alias("_rest"))
    q = F.regexp_replace(F.regexp_replace(F.col("_q"), r"^(\d+)(?: and |-)(\d+/\d+)$", "$1 $2"), r"(?i) ?(?:-|–|to|or) ?", "-")
    found = found.withColumn("_q", q)
    found = found.withColumn("_q", F.when(F.col("_q").startswith("."), F.concat(F.lit("0"), "_q")).otherwise(F.col("_q")))
    q, whole = F.col("_q"), ~F.col("_got")
    names = F.create_map(*[F.lit(x) for pair in UNIT_NAMES.items() for x in pair])
    unit = F.when(whole | (F.col("_u") == ""), "count").otherwise(F.coalesce(F.element_at(names, F.col("_u")), F.col("_u")))
    form = F.when(whole, "whole").when(F.col("_size") != "", "sized").when(F.col("_about") != "", "about").when(q.contains("-"), "range").when(q.contains(" "), "mixed").when(F.col("_u") == "", "count").otherwise("plain")
    name = F.trim(F.regexp_replace(F.regexp_replace(F.col("_rest"), r"\s*\([^)]*\)\s*", " "), r"\s+", " "))
    return found.select(*keep, F.when(whole, "1").otherwise(q).alias("quantity"), unit.alias("unit"), name.alias("name"), F.regexp_extract("_rest", r"\(([^)]+)\)", 1).alias("context"), form.alias("form"))


# What a second measure in a line may look like, in the order in which they are looked for. Each has pairs of groups of
# a quantity and its unit; matches of different patterns may overlap.
_MIXED = r"\d+(?:\.\d+)?(?:\s+\d+/\d+)?"
MEASURES = [
    (rf"({_MIXED}(?:\s*[-–]\s*\d+)?)\s*(cups?|c\.?)\b", [(1, 2)]),
    (rf"({_MIXED})\s*(tablespoons?|tbsp\.?|tb|tbs)\b", [(1, 2)]),
    (rf"({_MIXED})\s*(teaspoons?|tsp\.?|ts)\b", [(1, 2)]),
    (rf"({_MIXED})\s*(pounds?|lbs?\.?|lb\.?)\b", [(1, 2)]),
    (rf"({_MIXED})\s*(ounces?|oz\.?)\b", [(1, 2)]),
    (r"(\d+(?:\.\d+)?)(g\.?)\b", [(1, 2)]),
    (r"(\d+(?:\.\d+)?)\s*(grams?|g\.?)\b", [(1, 2)]),
    (r"(\d+(?:\.\d+)?)\s*(kilograms?|kg)\b", [(1, 2)]),
    (r"([¼⅓½⅔¾])\s*(cups?|tablespoons?|teaspoons?|ounces?|pounds?)\b", [(1, 2)]),
    (r"(\d+(?:\.\d+)?)(g)/(\d+(?:\.\d+)?)([a-z]+)\b", [(1, 2), (3, 4)]),
]


def alternative_units(line: str | Column) -> Column:
    """Every measure that a line mentions, as struct(quantity, unit): mixed numbers, ranges of cups, decimals, fraction signs and
    pairs such as 400g/14oz. In the order of MEASURES, each (quantity, unit) once; units by UNIT_NAMES, others as they stand."""
    names = F.create_map(*[F.lit(x) for pair in UNIT_NAMES.items() for x in pair])
    named = lambda u: F.coalesce(F.element_at(names, F.regexp_replace(F.lower(u), r"\.$", "")), u)

    def of_pattern(pattern: str, pairs: list[tuple[int, int]]) -> Column:
        """Texts of a quantity and its unit. One search finds a pattern's matches; a match of two pairs is parted at its slash."""
        matches = F.regexp_extract_all(col(line), F.lit(f"(?i){pattern}"), F.lit(0))
        return matches if len(pairs) == 1 else F.flatten(F.transform(matches, lambda m: F.split(m, "/")))

    # a quantity has no letters, so the first letter parts them
    mention = lambda m: F.struct(F.trim(F.regexp_extract(m, "^[^A-Za-z]*", 0)).alias("quantity"), named(F.trim(F.regexp_extract(m, "[A-Za-z].*$", 0))).alias("unit"))
    return F.array_distinct(F.transform(F.array_distinct(F.concat(*[of_pattern(*m) for m in MEASURES])), mention))


# Units and size words that may be glued to a number, and what may be glued to a unit.
GLUED_UNITS = ["tablespoons", "tablespoon", "teaspoons", "teaspoon", "packages", "package", "ounces", "ounce", "pounds", "pound", "kilograms", "kilogram", "grams", "gram", "cups", "cup", "gallons", "gallon", "quarts", "quart", "pints", "pint", "liters", "liter", "milliliters", "milliliter", "tbsp", "tsp", "oz", "lb", "lbs", "kg", "ml", "g", "can", "cans", "jar", "jars", "box", "boxes", "each", "large", "medium", "small", "whole", "dash"]
SIZE_WORDS = ["large", "medium", "small", "whole", "extra", "jumbo"]
GLUED_WORDS = ["heavy", "nutmeg", "storebought", "vanilla", "butter", "cream", "sugar", "flour", "salt", "pepper"]
ALL_SIGNS = "½¼¾⅐⅑⅒⅓⅔⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞"
LONGEST = "|".join(sorted(GLUED_UNITS, key=len, reverse=True))
_WORD_BEHIND = rf"[A-Z]|(?i:{'|'.join(GLUED_WORDS)})"
#: One token of a line: fraction, number, fraction sign, unit that a word is glued to, word, blanks, or any other character.
LINE_TOKEN = rf"(?s)\d+/\d+|\d+|[{ALL_SIGNS}]|(?i:{LONGEST})(?={_WORD_BEHIND})|[\p{{L}}_]+|\s+|."


def spacing_repair(text: str | Column) -> Column:
    """A line with its spaces set: between a number, fraction or sign and the unit or size word glued to it, between a unit and a
    capital or known word glued to that, and behind a closing bracket; the dot after a unit goes, blanks are squeezed, and a
    glued mixed number (11/2) is parted.

    The line is cut into tokens once, longest unit first, and each token is judged by the two before it.
    """
    parts = F.regexp_extract_all(F.trim(col(text)), F.lit(LINE_TOKEN), F.lit(0))

    def joined(tokens: Column) -> Column:
        def shown(x: Column, i: Column) -> Column:
            last, older = F.coalesce(F.get(tokens, i - 1), F.lit("")), F.coalesce(F.get(tokens, i - 2), F.lit(""))
            dropped = (last == ".") & older.rlike(rf"(?i)(?:{LONGEST})$")
            unit = F.when(dropped, older).otherwise(last)
            to_number = last.rlike(rf"^(?:\d+|\d+/\d+|[{ALL_SIGNS}])$") & x.rlike(rf"^(?i:{LONGEST}|{'|'.join(SIZE_WORDS)})")
            to_unit = unit.rlike(rf"^(?i:{LONGEST})$") & x.rlike(rf"^(?:{_WORD_BEHIND})")
            to_bracket = (last == ")") & older.rlike(r"[\p{L}\p{N}_]$") & x.rlike("^[a-z]")
            mixed = x.rlike(r"^\d\d/\d+$") & ~last.rlike(r"[\p{L}\p{N}_]$")
            plain = F.when((x == ".") & last.rlike(rf"(?i)(?:{LONGEST})$"), "").when(x.rlike(r"^\s+$"), " ").when(mixed, F.regexp_replace(x, r"^(\d)(\d)/", "$1 $2/")).otherwise(x)
            return F.when(to_number | to_unit | to_bracket, F.concat(F.lit(" "), plain)).otherwise(plain)

        return F.array_join(F.transform(tokens, shown), "")

    # as the only element of an array, the tokens are found once and not once for each use
    return F.trim(F.regexp_replace(F.get(F.transform(F.array(parts), joined), F.lit(0)), " +", " "))


def canonical_unit(unit: Column) -> Column:
    """The name of UNIT_NAMES, else the unit, trimmed and in lower case."""
    key = F.lower(F.trim(unit))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in UNIT_NAMES.items() for x in pair]), key), key)


_WHOLE_OR_FRACTION = r"(?:\d+\s+\d+/0*[1-9]\d*|\d+/0*[1-9]\d*|\d+)"


def quantity_text(quantity: Column) -> Column:
    """A quantity as decimal text: the larger end of a range of whole numbers and fractions, the value of a fraction or mixed
    number, without `.0`; any other text as it is, trimmed. Null is empty."""

    def text(t: Column) -> Column:
        value = quantity_value(F.regexp_replace(t, r"\s+", " "), "max")
        shown = F.regexp_replace(value.cast("string"), r"\.0$", "")
        return F.when(t.rlike("[-/]") & t.rlike(rf"^{_WHOLE_OR_FRACTION}(?:\s*-\s*{_WHOLE_OR_FRACTION})?$"), shown).otherwise(t)

    return _let(F.trim(F.coalesce(quantity, F.lit(""))), text)


def normalise_unit(df: DataFrame, unit: str, output: str = "unit", unit_map: DataFrame | None = None) -> DataFrame:
    """The canonical unit of UNIT_NAMES, or of a table (from_unit, to_unit), else the unit in lower case."""
    if unit_map is None:
        return df.withColumn(output, canonical_unit(F.col(unit)))
    key = F.lower(F.trim(F.col(unit)))
    joined = df.withColumn("_key", key).join(small(unit_map.select(F.col("from_unit").alias("_key"), "to_unit")), "_key", "left")
    return joined.withColumn(output, F.coalesce("to_unit", "_key")).drop("_key", "to_unit")


_N = r"(\d+(?:\.\d+)?)"
# Least and most that is plausible, and patterns in order, of each nutrient; numbers before names come first.
NUTRIENTS = {
    "calories": (10, 5000, [r"(\d{2,4})\s*calories\b", r"(\d{2,4})\s*kcal\b", r"calories[:\s]*(\d{2,4})\b", r"energy[:\s]*(\d{2,4})\b"]),
    "protein": (0, 200, [rf"{_N}\s*g\s*protein\b", rf"{_N}\s*grams?\s*protein\b", rf"protein[:\s]*{_N}\s*g?\b"]),
    "carbs": (0, 200, [rf"{_N}\s*g\s*carbohydrates?\b", rf"{_N}\s*g\s*carbs\b", rf"carbohydrates?[:\s]*{_N}\s*g?\b", rf"carbs[:\s]*{_N}\s*g?\b", rf"total\s+carbohydrates?[:\s]*{_N}\b"]),
    "fat": (0, 200, [rf"{_N}\s*g\s*fat\b", rf"{_N}\s*g\s*total\s*fat\b", rf"(?:total\s+)?fat[:\s]*{_N}\s*g?\b"]),
    "fiber": (0, 200, [rf"{_N}\s*g\s*fib(?:er|re)\b", rf"fib(?:er|re)[:\s]*{_N}\s*g?\b"]),
    "sugar": (0, 200, [rf"{_N}\s*g\s*sugars?\b", rf"sugars?[:\s]*{_N}\s*g?\b"]),
    "sodium": (0, 10000, [rf"{_N}\s*mg\s*sodium\b", rf"sodium[:\s]*{_N}\s*(?:mg)?\b"]),
}
#: Replacements that part letters from digits and names from what they are glued to, and phrases that are dropped (fixed values).
NUTRITION_CLEAN = [(r"([a-z])(\d)", "$1 $2"), (r"(\d)([a-z])", "$1 $2"), ("(calories|protein|carbs|carbohydrates|fat|fiber|sugar|sodium)", " $1"), ("per serving|per portion|amount per serving|nutrition facts", "")]


def nutrition_values(lines: Column, nutrients: dict[str, tuple[float, float, list[str]]] = NUTRIENTS) -> list[Column]:
    """The first plausible value of each nutrient in an array of texts, in any of the usual spellings, glued ones too."""
    t = F.lower(F.array_join(lines, " "))
    for pattern, by in NUTRITION_CLEAN:
        t = F.regexp_replace(t, pattern, by)

    def first_plausible(text: Column, lo: float, hi: float, patterns: list[str]) -> Column:
        values = F.array(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double") for p in patterns])
        return F.get(F.filter(values, lambda v: v.between(lo, hi)), F.lit(0))

    found = _let(t, lambda x: F.struct(*[first_plausible(x, *of).alias(name) for name, of in nutrients.items()]))
    return [found[name].alias(name) for name in nutrients]


def duration_minutes(text: str | Column) -> Column:
    """Whole minutes, rounded down, of an ISO duration (days to seconds), of hours and minutes in words (decimals too), of a bare
    number, or of the first number of any other text."""
    t = F.lower(F.trim(col(text)))
    number = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).try_cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    iso = zero(number(r"(\d+(?:\.\d+)?)d")) * 1440 + zero(number(r"t.*?(\d+(?:\.\d+)?)h")) * 60 + zero(number(r"t.*?(\d+(?:\.\d+)?)m")) + zero(number(r"(\d+(?:\.\d+)?)s")) / 60
    hours, minutes = number(r"(\d+(?:\.\d+)?) *(?:hours?|hrs?|h\b)"), number(r"(\d+(?:\.\d+)?) *(?:minutes?|mins?|m\b)")
    words = F.when(hours.isNotNull() | minutes.isNotNull(), zero(hours) * 60 + zero(minutes))
    plain = F.when(t.rlike(r"^\d+$"), t.try_cast("double"))
    value = F.when(t.rlike(r"^p(?=\d|t\d)(?:[\d.]+d)?(?:t(?:[\d.]+h)?(?:[\d.]+m)?(?:[\d.]+s)?)?$"), iso).otherwise(F.coalesce(plain, words, number(r"(\d+)")))
    return F.floor(value + 1e-9).cast("int")


#: The title of a text without any line (fixed value).
UNTITLED = "Untitled Recipe"


def directions(text: str | Column) -> Column:
    """Struct(title, steps): the first line that isn't blank, and the others without their numbers, empty ones left out."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), bare), lambda x: x != "")
    steps = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: bare(F.regexp_replace(x, r"^\d+\.\s*", ""))), lambda x: x != "")
    return F.struct(F.coalesce(F.get(lines, F.lit(0)), F.lit(UNTITLED)).alias("title"), steps.alias("steps"))


def mapping_rows(text: str | Column) -> Column:
    """`Step1:I1,I2|Step2:I3` -> array of (step, item); fragments that don't fit are dropped."""
    fragments = F.filter(F.split(col(text), r"\|"), lambda x: x.rlike(r"^[A-Za-z]+_?\d+:[A-Z0-9,]+$"))
    return F.flatten(F.transform(fragments, lambda x: F.transform(F.filter(F.split(F.split_part(x, F.lit(":"), F.lit(2)), ","), lambda i: i != ""), lambda i: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("step"), i.alias("item")))))


# What a name of a failed parse may hold, and phrases of a line that is not simple.
SUSPECT_UNITS = ["cup", "oz", "lb", "tsp", "tbsp", "tablespoon", "teaspoon"]
COMPLEX_PHRASES = ["to taste", "if desired", "preferably", "softened"]


def suspect_parse(quantity: Column, unit: Column, name: Column) -> Column:
    """Whether a `1 count` still has a digit or one of SUSPECT_UNITS anywhere in its name."""
    name = F.coalesce(name, F.lit(""))
    return F.coalesce((quantity == "1") & (unit == "count"), F.lit(False)) & (name.rlike(r"\d") | F.lower(name).rlike("|".join(SUSPECT_UNITS)))


def complex_line(text: Column) -> Column:
    """Whether a line has more than 30 characters or one of COMPLEX_PHRASES."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (F.length(t) > 30) | t.rlike("|".join(COMPLEX_PHRASES))


def clean_name(text: Column, suffixes: list[str]) -> Column:
    """Lower case, without suffix words, blanks squeezed, blank as null."""
    t = F.regexp_replace(F.lower(F.trim(text)), rf"\b(?:{'|'.join(suffixes)})\b", "")
    return F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def word_set(text: Column) -> Column:
    """Distinct content words: without measures, digits, descriptors and stop words, longer than two letters, all of them a to z."""
    t = F.regexp_replace(F.lower(text), rf"(?U)\b\d+(?:/\d+)?\s*{MEASURE}\b", "")
    words = F.split(F.regexp_replace(t, r"\d+(?:\.\d+)?", ""), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin([*STOP_WORDS, *DESCRIPTORS])))


# Addresses that are no single recipe, of other pages, and of categories.
LIST_URLS = [r"/recipes/collection/", r"/recipes/category/", r"/recipes/tag/", r"/collection/", r"/category/", r"roundup", r"best-.*-recipes", r"top-.*-recipes", r"-recipes/?$", r"guide/", r"howto/"]
OTHER_URLS = [r"/(about|contact|privacy|terms)", r"/(category|tag|author)", r"/#", r"/page/", r"/(feed|rss)", r"/(search|shop|store)", r"/wp-", r"javascript:", r"mailto:", r"tel:", r"/(login|register)", r"/(newsletter|subscribe)"]
CATEGORY_URLS = [r"/recipes/$", r"/account/", r"/add-recipe", r"/recipes/\d+/$", r"/recipes/\d+/[^/]+/$", r"/(dinner|lunch|breakfast|dessert|appetizer|snack)/$", r"/meal-ideas/", r"/(main-dishes|side-dishes|salads|soups|beverages)/$", r"/cooking/", r"/5-ingredients/", r"/everyday-cooking/", r"/more-meal-ideas/"]
RECIPE_URLS = [r"/recipe/[^/]+/?$", r"/recipes/[^/]+/?$", r"-recipe/?$", r"-recipe\.", r"recipe\?", r"/\d{4}/\d{2}/.+"]
#: Entities that are read as characters (fixed values).
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def _characters(text: Column) -> Column:
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in the text between a tag's name and its end, quoted either way or not at all; null without one."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    return F.when(tag.rlike(pattern), _characters(value))


def absolute_url(base: Column, href: Column) -> Column:
    """The address that a link means on a page: with its own scheme, `//host`, from the root, a query or fragment, or beside the
    page's path, without `.` and `..`."""
    site, scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    page = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    whole = F.when(path.startswith("/"), path).when(path == "", F.when(page == "", "/").otherwise(page)).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract(page, r"^(.*/)", 1), F.lit("")), F.lit("/")), path))
    parts = F.slice(F.split(whole, "/", -1), 2, 1 << 20)
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.array_append(a, x)))
    kept = F.when(whole.rlike(r"/\.{1,2}$"), F.array_append(kept, F.lit(""))).otherwise(kept)
    query = F.when(rest.startswith("#") & (path == ""), F.concat(F.regexp_extract(base, r"(\?[^#]*)", 1), rest)).otherwise(rest)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).otherwise(F.concat(site, F.lit("/"), F.array_join(kept, "/"), query))


def page_links(pages: DataFrame, page_id: str, url: str, html: str, include: list[str] = RECIPE_URLS, exclude: list[str] = [*LIST_URLS, *OTHER_URLS, *CATEGORY_URLS], least: int = 5) -> DataFrame:  # noqa: B006
    """Distinct (page, link, label): absolute addresses of a page's links whose label has `least` characters and whose address in lower case
    fits one of `include` and none of `exclude`. Attributes may come in any order and quoting; tags inside a label are left out."""
    anchor = F.lit(r"(?is)<a\b([^>]*)>(.*?)</a\s*>")
    zipped = F.arrays_zip(F.regexp_extract_all(html, anchor, F.lit(1)).alias("tag"), F.regexp_extract_all(html, anchor, F.lit(2)).alias("inner"))
    rows = pages.select(page_id, F.col(url).alias("_url"), F.inline(zipped)).withColumn("_href", F.trim(attribute(F.col("tag"), "href")))
    label = F.regexp_replace(_characters(F.regexp_replace("inner", r"(?s)<[^>]*>", "")), r"^\s+|\s+$", "")
    links = rows.filter("_href <> ''").select(page_id, absolute_url(F.col("_url"), F.col("_href")).alias("link"), label.alias("label"))
    fits = F.lower("link").rlike("|".join(include)) & (~F.lower("link").rlike("|".join(exclude)) if exclude else F.lit(True))
    return links.filter((F.length("label") >= least) & fits).distinct()


def page_jsonld(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """The first recipe with a title and ingredients in a page's JSON-LD blocks (an object or an array of objects): title, ingredients,
    instructions, nutrition (up to four texts), cook_time (the total time, if there is one), prep_time, servings and image_url.

    A recipe says so in @type, a text or a list. Blocks that are no JSON and entries that are no objects are skipped. Instructions may be
    a text, or a list of texts and of objects with a text; a yield or an image may be a list, of which the first entry counts, an image an
    object with a url. Missing fields are empty.
    """
    spark = pages.sparkSession
    script = F.lit(r"(?is)<script\b([^>]*)>(.*?)</script\s*>")
    zipped = F.arrays_zip(F.regexp_extract_all(html, script, F.lit(1)).alias("tag"), F.regexp_extract_all(html, script, F.lit(2)).alias("body"))
    blocks = pages.select(page_id, F.posexplode(zipped).alias("block", "s")).filter(F.lower(F.trim(attribute(F.col("s.tag"), "type"))) == "application/ld+json")
    body = F.regexp_replace("s.body", r"^\s+|\s+$", "")
    parsed = blocks.select(page_id, "block", F.try_parse_json(F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))).alias("v")).filter("v IS NOT NULL")
    items = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(page_id, "block", "pos", F.col("value").alias("r"))
    text = lambda v, path: F.try_variant_get(v, path, "string")
    items = items.filter(F.schema_of_variant("r").startswith("OBJECT"))
    many = lambda path: F.try_variant_get("r", path, "array<variant>")
    kind = lambda v: F.schema_of_variant(v)
    is_recipe = F.coalesce(text("r", '$["@type"]') == "Recipe", F.lit(False)) | F.coalesce(F.array_contains(F.try_variant_get("r", '$["@type"]', "array<string>"), "Recipe"), F.lit(False))
    none = F.array().cast("array<string>")
    listed = lambda path, of: F.coalesce(F.filter(F.transform(many(path), of), lambda x: x != ""), F.filter(F.array(text("r", path)), lambda x: x != ""), none)
    plain = lambda v: F.when(kind(v) == "STRING", text(v, "$"))
    step = lambda v: F.when(kind(v) == "STRING", text(v, "$")).when(kind(v).startswith("OBJECT"), text(v, "$.text"))
    first = lambda path: F.coalesce(F.get(many(path), F.lit(0)), F.try_variant_get("r", path, "variant"))
    shown = lambda v: F.when(~kind(v).rlike("^(?:OBJECT|ARRAY|VOID)"), text(v, "$"))
    image = first("$.image")
    values = [F.concat(F.nullif(text("r", f"$.nutrition.{field}"), F.lit("")), F.lit(f" {name}")) for field, name in (("calories", "calories"), ("proteinContent", "protein"), ("fatContent", "fat"), ("carbohydrateContent", "carbs"))]
    filled_or = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    recipe = F.struct(
        F.coalesce(text("r", "$.name"), F.lit("")).alias("title"),
        listed("$.recipeIngredient", plain).alias("ingredients"),
        listed("$.recipeInstructions", step).alias("instructions"),
        F.array_compact(F.array(*values)).alias("nutrition"),
        filled_or(text("r", "$.totalTime"), text("r", "$.cookTime")).alias("cook_time"),
        filled_or(text("r", "$.prepTime")).alias("prep_time"),
        filled_or(shown(first("$.recipeYield")), shown(first("$.yield"))).alias("servings"),
        filled_or(F.when(kind(image).startswith("OBJECT"), text(image, "$.url")).when(kind(image) == "STRING", text(image, "$"))).alias("image_url"),
    )
    good = items.filter(is_recipe).select(page_id, "block", "pos", recipe.alias("recipe")).filter((F.col("recipe.title") != "") & (F.size("recipe.ingredients") > 0))
    return good.groupBy(page_id).agg(F.min_by("recipe", F.struct("block", "pos")).alias("recipe")).select(page_id, "recipe.*")
