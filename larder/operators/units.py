"""Unit conversion to grams, negligible ingredients, and checks of nutrition rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.lookups import portion_match, small

# Grams per weight unit, grams per tiny unit, millilitres per volume unit. A trailing s of a unit is dropped before.
WEIGHT = {"g": 1.0, "gram": 1.0, "kg": 1000.0, "kilogram": 1000.0, "oz": 28.35, "ounce": 28.35, "lb": 453.59, "pound": 453.59}
TINY = {"pinch": 0.35, "dash": 0.5, "smidgen": 0.18, "hint": 0.25, "drop": 0.05, "splash": 2.0, "drizzle": 5.0, "squeeze": 10.0}
VOLUME = {"cup": 240.0, "tbsp": 15.0, "tablespoon": 15.0, "tsp": 5.0, "teaspoon": 5.0, "ml": 1.0, "milliliter": 1.0, "l": 1000.0, "liter": 1000.0}
#: Units that say nothing of an amount, and units that count pieces (fixed values).
AMBIGUOUS = ["count", "piece", "each", "unit", "to taste", "some", ""]
PIECE_UNITS = ["count", "piece", "clove"]
#: Units of negligible amounts (fixed values).
NEGLIGIBLE_UNITS = ["pinch", "dash", "drop", "hint", "touch", "smidgen", "to taste"]

# Grams per cup, by the first key that the name contains. Keys that hold an earlier one are left out, as they
# can't be reached.
DENSITY = {
    "flour": 120, "oat": 80, "rice": 185, "quinoa": 170, "cornmeal": 138, "sugar": 200, "honey": 340, "maple syrup": 315, "butter": 227, "oil": 220,
    "water": 240, "milk": 240, "cream": 240, "yogurt": 245, "almond": 140, "walnut": 120, "pecan": 110, "peanut": 145, "cashew": 130, "cocoa powder": 85, "chocolate chips": 170,
}

# Grams per piece, by the first key that the name contains, again without keys that hold an earlier one.
PIECE = {
    "egg": 50, "garlic": 3, "clove": 3, "onion": 150, "shallot": 25, "potato": 150, "yukon gold": 150,
    "cherry tomato": 17, "grape tomato": 10, "roma tomato": 100, "plum tomato": 100, "beefsteak tomato": 200, "tomato": 150,
    "baby carrot": 10, "medium carrot": 60, "carrot": 60, "celery": 40, "english cucumber": 400, "persian cucumber": 150, "baby cucumber": 150, "cucumber": 300,
    "bell pepper": 150, "jalapeño": 15, "habanero": 10, "serrano": 12, "poblano": 80, "cayenne": 8, "zucchini": 200, "yellow squash": 200, "avocado": 150,
    "lemon": 50, "lime": 45, "orange": 130, "grapefruit": 250, "tangerine": 90, "ginger": 15, "mushroom": 15, "portobello": 80, "shiitake": 10, "cremini": 15,
    "brussels sprout": 10, "asparagus": 15, "broccoli floret": 20, "cauliflower floret": 15, "radish": 10, "turnip": 150, "beet": 80, "rutabaga": 400, "corn": 150, "artichoke": 150, "leek": 100,
    "basil leaf": 0.5, "basil": 0.5, "mint leaf": 0.5, "mint": 0.5, "parsley": 0.5, "cilantro": 0.5, "coriander leaf": 0.5, "sage leaf": 0.3, "thyme sprig": 1, "rosemary sprig": 2, "dill sprig": 1, "dill": 1, "bay leaf": 0.3,
    "lettuce leaf": 15, "romaine leaf": 20, "iceberg leaf": 15, "spinach leaf": 5, "spinach": 5, "kale leaf": 8, "kale": 8, "arugula": 2, "watercress": 2,
    "apple": 180, "banana": 120, "pear": 170, "peach": 150, "plum": 65, "nectarine": 140, "strawberry": 15, "strawberries": 15, "blueberry": 1, "blueberries": 1, "raspberry": 1, "raspberries": 1,
    "blackberry": 2, "blackberries": 2, "cranberry": 1, "cranberries": 1, "grape": 3, "cherry": 8, "cherries": 8, "mango": 200, "papaya": 450, "kiwi": 70, "fig": 50, "date": 7, "apricot": 35,
    "cantaloupe": 600, "honeydew": 900, "watermelon": 4500, "coconut": 400, "pomegranate": 250, "raisin": 0.5, "prune": 10,
    "chicken breast": 200, "chicken thigh": 150, "chicken wing": 50, "chicken drumstick": 100, "chicken tender": 40, "pork chop": 180, "pork tenderloin": 450, "pork rib": 70, "steak": 250, "beef patty": 115,
    "lamb chop": 150, "lamb shank": 250, "sausage": 50, "hot dog": 45, "bratwurst": 85, "bacon strip": 15, "bacon slice": 15, "bacon rasher": 15, "meatball": 25,
    "salmon fillet": 180, "cod fillet": 170, "tilapia fillet": 150, "shrimp": 15, "prawn": 20, "scallop": 30, "oyster": 20, "clam": 15, "mussel": 10, "crab leg": 50, "lobster tail": 200,
    "slice bread": 30, "bread slice": 30, "toast": 30, "bread roll": 50, "bagel": 85, "english muffin": 60, "pita": 60, "tortilla": 50, "naan": 90, "flatbread": 60, "croissant": 50, "donut": 60, "doughnut": 60,
    "muffin": 60, "biscuit": 60, "scone": 70, "pancake": 40, "waffle": 75, "crumpet": 60, "walnut": 5, "almond": 1.2, "pecan": 5, "cashew": 2, "peanut": 1, "macadamia": 2, "pistachio": 1, "hazelnut": 1.5,
    "brazil nut": 5, "pine nut": 0.1, "sunflower seed": 0.05, "olive": 4, "chocolate chip": 0.3, "chocolate square": 5,
}

# Seasonings. A name is one if it holds a seasoning or is part of one, so longer names of those listed matter only
# for the second test.
SEASONINGS = [
    "salt", "sea salt", "kosher salt", "table salt", "himalayan salt", "pink salt", "fleur de sel", "flaky salt",
    "pepper", "black pepper", "white pepper", "ground pepper", "cracked pepper", "peppercorns", "black peppercorns", "white peppercorns",
    "paprika", "smoked paprika", "sweet paprika", "hot paprika", "cayenne", "cayenne pepper", "red pepper flakes", "crushed red pepper", "chili powder", "chile powder", "chili flakes",
    "cumin", "ground cumin", "cumin seed", "cumin seeds", "coriander", "ground coriander", "coriander seed", "coriander seeds", "turmeric", "ground turmeric", "cinnamon", "ground cinnamon", "nutmeg", "ground nutmeg",
    "allspice", "ground allspice", "cloves", "ground cloves", "whole cloves", "ginger powder", "ground ginger", "dried ginger", "cardamom", "ground cardamom", "curry powder", "garam masala", "chinese five spice", "five spice",
    "oregano", "dried oregano", "basil", "dried basil", "thyme", "dried thyme", "rosemary", "dried rosemary", "sage", "dried sage", "parsley", "dried parsley", "dill", "dried dill", "dill weed", "bay leaf", "bay leaves",
    "tarragon", "dried tarragon", "marjoram", "dried marjoram", "garlic powder", "garlic salt", "granulated garlic", "onion powder", "onion salt", "granulated onion", "msg", "monosodium glutamate", "celery salt", "celery seed",
    "mustard powder", "dry mustard", "mustard seed", "caraway seed", "caraway seeds", "fennel seed", "fennel seeds", "poppy seed", "poppy seeds", "sesame seed", "sesame seeds", "za'atar", "zaatar", "sumac", "saffron",
    "herbs de provence", "herbes de provence", "italian seasoning", "poultry seasoning", "taco seasoning", "old bay", "cajun seasoning", "creole seasoning", "everything bagel seasoning",
]

# Beginnings of names, and whole names, of ingredients without a share in the nutrition.
NEGLIGIBLE_STARTS = [
    "pinch of", "a pinch of", "small pinch", "squeeze of", "a squeeze of", "dash of", "a dash of", "splash of", "a splash of", "drizzle of", "a drizzle of", "drop of", "drops of", "a drop of", "hint of", "a hint of",
    "touch of", "a touch of", "to taste", "as needed", "as required", "to season", "for seasoning", "for garnish", "as garnish", "for decoration", "to serve", "for serving", "zest of", "lemon zest", "lime zest", "orange zest",
]
NEGLIGIBLE_NAMES = [
    "water", "ice", "ice cubes", "cold water", "hot water", "warm water", "boiling water", "filtered water", "tap water", "salt", "pepper", "black pepper", "sea salt", "kosher salt",
]


def singular(unit: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(unit)), "s$", "")


def dictionaries(spark, density: dict | None = None, piece: dict | None = None, seasonings: list[str] | None = None) -> DataFrame:
    """(kind, ordinal, key, value): densities, piece weights and seasonings in one table, built in or given."""
    parts = [("density", DENSITY if density is None else density), ("piece", PIECE if piece is None else piece), ("seasoning", dict.fromkeys(SEASONINGS if seasonings is None else seasonings, 1.0))]
    return spark.createDataFrame([(kind, o, k, float(v)) for kind, d in parts for o, (k, v) in enumerate(d.items())], "kind string, ordinal int, key string, value double")


def name_facts(names: DataFrame, dictionary: DataFrame, name: str) -> DataFrame:
    """(_name, density, piece, seasoning) of the distinct names, in lower case: the first key of each kind that the name contains;
    a seasoning may contain the name, too. Names x keys, never rows x keys; names without any are left out."""
    distinct = names.select(F.lower(F.trim(F.col(name))).alias("_name")).distinct()
    hit = F.contains("_name", "key") | ((F.col("kind") == "seasoning") & F.contains("key", "_name"))
    found = distinct.join(small(dictionary), hit).groupBy("_name", "kind").agg(F.min_by("value", "ordinal").alias("v")).groupBy("_name")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("v")))
    return found.agg(of("density").alias("density"), of("piece").alias("piece"), of("seasoning").isNotNull().alias("seasoning"))


def with_facts(df: DataFrame, facts: DataFrame, name: str) -> DataFrame:
    """`df` with density, piece and seasoning of its names."""
    return df.withColumn("_name", F.lower(F.trim(F.col(name)))).join(facts, "_name", "left").withColumn("seasoning", F.coalesce("seasoning", F.lit(False))).drop("_name")


def grams(quantity: Column, unit: Column, portions: Column, density: Column, piece: Column, seasoning: Column, extra: dict[str, tuple[str, float]] | None = None) -> Column:
    """Struct(grams, gram_source): weight unit, tiny unit, volume by portion, density or water, seasoning of an ambiguous unit 1 g,
    piece weight or 50 g, else 100 g, all times the quantity (null: 1). `extra` units win over built-in ones."""
    known = {u: (kind, f) for kind, units in (("weight", WEIGHT), ("tiny", TINY), ("volume", VOLUME)) for u, f in units.items()} | (extra or {})
    factors = {k: F.element_at(F.create_map(*chain.from_iterable((F.lit(u), F.lit(float(f))) for u, (kind, f) in known.items() if kind == k)), singular(unit)) for k in ("weight", "tiny", "volume")}
    q, u, by_portion = F.coalesce(quantity, F.lit(1.0)), singular(unit), portion_match(unit, portions)
    weight, tiny, volume = factors["weight"], factors["tiny"], factors["volume"]
    cases: list[tuple[Column, Column, str]] = [
        (weight.isNotNull(), q * weight, "weight"),
        (tiny.isNotNull(), q * tiny, "tiny"),
        (volume.isNotNull() & by_portion.isNotNull(), q * by_portion, "portion"),
        (volume.isNotNull() & density.isNotNull(), q * volume * density / 240, "density"),
        (volume.isNotNull(), q * volume, "water"),
        (u.isin(AMBIGUOUS) & seasoning, q * 1.0, "seasoning"),
        (u.isin(PIECE_UNITS) & piece.isNotNull(), q * piece, "piece"),
        (u.isin(PIECE_UNITS), q * 50.0, "piece_default"),
    ]
    make = lambda value, label: F.struct(F.round(value, 4).alias("grams"), F.lit(label).alias("gram_source"))
    out = F.when(cases[0][0], make(cases[0][1], cases[0][2]))
    for condition, value, label in cases[1:]:
        out = out.when(condition, make(value, label))
    return out.otherwise(make(q * 100.0, "default"))


def to_grams(lines: DataFrame, dictionary: DataFrame, quantity: str = "quantity", unit: str = "unit", name: str = "name", portions: str = "portions", names: DataFrame | None = None, extra: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """`lines` with grams and gram_source. `names`, a smaller table with all names, saves a scan of the lines."""
    rows = with_facts(lines, name_facts(lines if names is None else names, dictionary, name), name)
    g = grams(F.col(quantity), F.col(unit), F.col(portions), F.col("density"), F.col("piece"), F.col("seasoning"), extra)
    return rows.withColumn("_g", g).select(*lines.columns, "_g.grams", "_g.gram_source")


def negligible(name: Column, quantity: Column, unit: Column, seasoning: Column) -> Column:
    """Whether an ingredient can be left out of the nutrition: a whole name, the beginning of a name, a tiny unit, or a seasoning of at
    most 2 teaspoons, 1 tablespoon or 2 pieces. A missing quantity counts as 1."""
    n, u, q = F.lower(F.trim(name)), F.lower(F.trim(unit)), F.coalesce(quantity, F.lit(1.0))
    few = (u.isin("tsp", "teaspoon", "teaspoons") & (q <= 2)) | (u.isin("tbsp", "tablespoon", "tablespoons") & (q <= 1)) | (u.isin("count", "piece", "pieces", "each", "") & (q <= 2))
    return F.coalesce(n.isin(NEGLIGIBLE_NAMES) | n.rlike(f"^(?:{'|'.join(NEGLIGIBLE_STARTS)})") | u.isin(NEGLIGIBLE_UNITS) | (seasoning & few), F.lit(False))


def override_water(lines: DataFrame, estimates: DataFrame, key: str, lo: float = 10.0, hi: float = 500.0) -> DataFrame:
    """Water defaults replaced by an estimate from lo to hi grams."""
    joined = lines.join(estimates.select(key, F.col("grams").alias("_estimate")), key, "left")
    return overridden(joined, F.col("_estimate"), lo, hi).drop("_estimate")


def overridden(lines: DataFrame, estimate: Column, lo: float = 10.0, hi: float = 500.0) -> DataFrame:
    use = (F.col("gram_source") == "water") & F.coalesce(estimate.between(lo, hi), F.lit(False))
    return lines.withColumns({"grams": F.when(use, estimate).otherwise(F.col("grams")), "gram_source": F.when(use, "estimate").otherwise(F.col("gram_source"))})


def rounded_total(macro: str) -> Column:
    """Sum of per-100 values times grams, half to even; summed as decimals, so the order of the rows doesn't matter."""
    return F.bround(F.sum(F.col(macro).cast("decimal(10,2)") * F.col("grams").cast("decimal(14,4)")).cast("double") / 100, 0)


#: Labels of where a weight comes from, in the order in which a mix names them (fixed values).
PROVENANCE = {
    "USDA_PORTION": ["portion"], "TABLE": ["tiny", "density", "piece"], "LLM_ESTIMATE": ["estimate"], "WATER": ["water"], "ESTIMATE": ["piece_default", "default"], "DIRECT": ["weight"], "NEGLIGIBLE": ["negligible"], "SEASONING_DEFAULT": ["seasoning"],
}


def without_negligible(lines: DataFrame, flag: Column) -> DataFrame:
    """Negligible ingredients weigh 0 g."""
    return lines.withColumns({"grams": F.when(flag, 0.0).otherwise(F.col("grams")), "gram_source": F.when(flag, "negligible").otherwise(F.col("gram_source"))})


def source_mix(lines: DataFrame, key: str, source: str = "gram_source") -> DataFrame:
    """`mix` of each key: the share of lines by PROVENANCE, as `A:62%,B:12%`; rounded half to even. One partial aggregation."""
    n = F.count(F.lit(1))
    g = lines.groupBy(key).agg(n.alias("n"), *[F.count_if(F.col(source).isin(kinds)).alias(label) for label, kinds in PROVENANCE.items()])
    shown = [F.when(F.col(c) > 0, F.concat(F.lit(f"{c}:"), F.bround(100.0 * F.col(c) / F.col("n"), 0).cast("int").cast("string"), F.lit("%"))) for c in PROVENANCE]
    return g.select(key, F.coalesce(F.nullif(F.concat_ws(",", *shown), F.lit("")), F.lit("UNKNOWN")).alias("mix"))


def reference_sanity(df: DataFrame, name: str) -> DataFrame:
    """Calories that are missing, or 0 beside other macros, filled by 9, 4, 4 (one digit); `sane` is false for impossible rows and for
    all zero unless salt or water. Missing macros count as 0."""
    fat, protein, carbs = (F.coalesce(c, F.lit(0.0)) for c in ("fat", "protein", "carbs"))
    given = F.coalesce("calories", F.lit(0.0))
    kcal = F.when((given == 0) & ((fat > 0) | (protein > 0) | (carbs > 0)), F.round(9 * fat + 4 * protein + 4 * carbs, 1)).otherwise(given)
    impossible = (carbs > 105) | (fat > 105) | (protein > 105) | (kcal > 950)
    nothing = (kcal == 0) & (fat == 0) & (protein == 0) & (carbs == 0)
    return df.withColumns({"calories": kcal, "sane": ~impossible & ~(nothing & ~F.coalesce(F.lower(F.col(name)).rlike("salt|water"), F.lit(False)))})
