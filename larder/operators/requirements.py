"""Requirement checks of recipes, with the layers kept apart so that a closest match can be explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.lookups import small


#: Diets that ingredients can be checked for (fixed values); others are left to a judge, as subjective ones.
KNOWN_DIETS = ["gluten_free", "dairy_free", "vegetarian", "vegan"]
SUBJECTIVE = ["meal_type", "cuisine_type", "cooking_method"]
#: Words of a meal type (fixed values).
MEAL_WORDS = {
    "breakfast": ["breakfast", "morning", "brunch", "oatmeal", "pancake", "waffle", "cereal", "granola", "smoothie", "egg", "toast", "muffin", "bagel"],
    "lunch": ["lunch", "sandwich", "salad", "soup", "wrap", "midday"],
    "dinner": ["dinner", "supper", "evening", "entree", "main course", "roast"],
    "dessert": ["dessert", "sweet", "cake", "cookie", "pie", "ice cream", "candy"],
    "snack": ["snack", "bite", "appetizer", "starter"],
}
_ROW = "array<struct<kind:string,name:string,lo:double,hi:double,term:string>>"


def categorise(df: DataFrame, key: str, document: str, diets: list[str] = KNOWN_DIETS) -> DataFrame:
    """Requirement documents -> typed rows (key, kind, name, lo, hi, term).

    nutrition: {nutrient: {min, max}} for any nutrients; time_constraints: "under N min"; allergies and exclude_ingredients are both
    `exclude`; include_ingredients; dietary_restrictions (a text or a list): known diets, with underscores, are `dietary`, the last
    unknown one is `subjective`, like meal_type, cuisine_type and cooking_method.
    """
    lists = ["allergies", "exclude_ingredients", "include_ingredients"]
    schema = f"nutrition map<string,struct<min:double,max:double>>, time_constraints string, {', '.join(f'{x} array<string>' for x in lists)}, dietary_restrictions string, {', '.join(f'{x} string' for x in SUBJECTIVE)}"
    parsed = df.select(key, F.from_json(document, schema).alias("r"))
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    row = lambda kind, name, lo=no_number, hi=no_number, term=no_text: F.struct(F.lit(kind).alias("kind"), name.alias("name"), lo.alias("lo"), hi.alias("hi"), term.alias("term"))
    none, none_text = F.array().cast(_ROW), F.array().cast("array<string>")
    entries = F.coalesce(F.map_entries("r.nutrition"), F.map_entries(F.create_map().cast("map<string,struct<min:double,max:double>>")))
    bounded = F.filter(F.transform(entries, lambda e: row("nutrition", e["key"], e["value"]["min"], e["value"]["max"])), lambda x: x["lo"].isNotNull() | x["hi"].isNotNull())
    minutes = F.regexp_extract(F.coalesce("r.time_constraints", F.lit("")), r"(?i)under\s+(\d+)\s*min", 1)
    timed = F.when(minutes != "", F.array(row("time", F.lit("cook_time"), hi=minutes.try_cast("double")))).otherwise(none)
    listed = lambda kind, column: F.transform(F.coalesce(F.col(f"r.{column}"), none_text), lambda x: row(kind, F.lit("term"), term=x))
    raw = F.col("r.dietary_restrictions")
    asked = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))
    asked = F.coalesce(asked, none_text)
    tag = lambda x: F.regexp_replace(F.lower(x), "[- ]", "_")
    dietary = F.transform(F.filter(asked, lambda x: tag(x).isin(diets)), lambda x: row("dietary", F.lit("term"), term=tag(x)))
    unknown = F.try_element_at(F.filter(asked, lambda x: ~tag(x).isin(diets)), F.lit(-1))
    subjective = F.filter(F.array(row("subjective", F.lit("dietary_restriction"), term=unknown), *[row("subjective", F.lit(x), term=F.col(f"r.{x}")) for x in SUBJECTIVE]), lambda x: x["term"].isNotNull())
    every = F.concat(bounded, timed, listed("exclude", "allergies"), listed("exclude", "exclude_ingredients"), listed("include", "include_ingredients"), dietary, subjective)
    return parsed.select(key, F.inline(every))


def nutrient_match(value: Column, lo: Column, hi: Column) -> Column:
    """100 if within the bounds, else how near: value / min, max / value; the smaller of both; missing is 0."""
    low = F.when(lo.isNull() | (value >= lo), 100.0).otherwise(100 * F.try_divide(value, lo))
    high = F.when(hi.isNull() | (value <= hi), 100.0).otherwise(100 * F.try_divide(hi, value))
    return F.when(value.isNull(), 0.0).otherwise(F.least(low, high))


def nutrition_match(values: DataFrame, needs: DataFrame, recipe: str, recipes: DataFrame | None = None) -> DataFrame:
    """Per recipe: nutrition_ok and nutrition_pct (mean match, one digit). values: recipe, name, value (a row per name at most); needs:
    name, lo, hi. A needed nutrient without a value is 0 % and fails. `recipes` adds recipes that have no values at all."""
    joined = values.join(small(needs.select("name", "lo", "hi")), "name")
    pct = nutrient_match(F.col("value"), F.col("lo"), F.col("hi"))
    found = joined.groupBy(recipe).agg(F.bool_and(pct >= 100).alias("_ok"), F.sum(pct).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    every = (values if recipes is None else recipes).select(recipe).distinct()
    total = needs.agg(F.count(F.lit(1)).alias("_needs"))  # one row
    rows = every.join(found, recipe, "left").crossJoin(F.broadcast(total))
    ok = (F.col("_needs") == 0) | (F.coalesce("_ok", F.lit(False)) & (F.col("_n") == F.col("_needs")))
    return rows.select(recipe, ok.alias("nutrition_ok"), F.round(F.coalesce(F.try_divide(F.coalesce("_sum", F.lit(0.0)), F.col("_needs")), F.lit(0.0)), 1).alias("nutrition_pct"))


def term_hits(words: DataFrame, terms: DataFrame, recipe: str, word: str = "word") -> DataFrame:
    """(recipe, term, word) where a word contains a term; distinct words meet the terms, then join back."""
    distinct = words.select(word).distinct()
    hits = distinct.join(small(terms.select("term").distinct()), F.contains(F.col(word), F.col("term")))
    return words.join(hits, word).select(recipe, "term", word).distinct()


def verify_all(recipes: DataFrame, layers: list[str], nutrition: str | None, pct: str) -> DataFrame:
    """`exact` where all layers pass. Other rows stay as partial ones, unless there is no nutrition requirement and another layer fails."""
    every = [F.col(x) for x in layers] + ([F.col(nutrition)] if nutrition else [])
    exact = every[0]
    for c in every[1:]:
        exact = exact & c
    rows = recipes.withColumn("exact", F.coalesce(exact, F.lit(False)))
    return rows if nutrition else rows.filter("exact")


def metadata_confidence(text: Column, meal_type: Column, tags: Column) -> Column:
    """Mean over the tests: 0.9 or 0.3 for words of the meal type (a known one), 0.95 or 0.4 for each tag, written with underscores,
    blanks or hyphens; 0.5 without any test."""
    t, meal = F.lower(F.coalesce(text, F.lit(""))), F.lower(meal_type)
    hit = F.coalesce(*[F.when(meal == m, t.rlike("|".join(words))) for m, words in MEAL_WORDS.items()])
    of_meal = F.when(hit, 0.9).when(~hit, 0.3)
    said = lambda tag: F.contains(t, F.replace(tag, F.lit("_"), F.lit(" "))) | F.contains(t, F.replace(tag, F.lit("_"), F.lit("-"))) | F.contains(t, tag)
    of_tags = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.when(said(x), 0.95).otherwise(0.4))
    scores = F.concat(F.array_compact(F.array(of_meal)), of_tags)
    return F.when(F.size(scores) == 0, 0.5).otherwise(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))


def from_query(text: Column) -> Column:
    """Constraints named in a query text, as `kind=value` strings."""
    t = F.lower(text)
    number = lambda pattern, name: F.when(F.regexp_extract(t, pattern, 1) != "", F.concat(F.lit(f"{name}="), F.regexp_extract(t, pattern, 1)))
    diets = [F.when(t.contains(w), F.lit(f"diet={w.replace('-', '_')}")) for w in QUERY_DIETS]
    found = F.array(*diets, number(r"(\d+)g?\s*protein", "protein"), number(r"(\d+)\s*calorie", "calories"), number(r"(\d+)\s*min", "minutes"), number(r"no\s+([\p{L}\p{N}_]+)", "exclude"))
    return F.array_compact(found)


#: Diets that a query may name (fixed values).
QUERY_DIETS = ["vegan", "vegetarian", "gluten-free", "dairy-free", "keto", "paleo", "nut-free"]


# Dishes that are looked for in the title only, or by other words than their own; what a diet or an allergy forbids among the ingredients.
TITLE_SUBJECTS = {"cheesecake": ["cheesecake"], "chocolate cake": ["cake", "chocolate"], "cake": ["cake", "chocolate"], "pizza": ["pizza"]}
DIET_FORBIDS = {
    "gluten-free": ("gluten_free", ["flour", "wheat", "bread", "pasta"]),
    "vegan": ("vegan", ["chicken", "beef", "pork", "fish", "egg", "milk", "cheese", "butter"]),
    "dairy-free": ("dairy_free", ["milk", "cheese", "butter", "cream", "yogurt"]),
    "keto": ("keto", ["flour", "sugar", "bread", "pasta", "rice"]),
}
ALLERGY_FORBIDS = {
    "nuts": ("nuts_excluded", ["nut", "almond", "walnut", "pecan", "cashew", "peanut"]),
    "shellfish": ("shellfish_excluded", ["shrimp", "crab", "lobster", "shellfish"]),
    "eggs": ("eggs_excluded", ["egg"]),
}
CONSTRAINTS = "subject string, dietary_constraints array<string>, allergy_constraints array<string>, nutrition_requirements array<string>, time_constraints string"


def constraint_rules(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, asked, rules): what each constraint document (JSON text) demands, compiled to rows that recipes can be tested with.

    rules is an array of (flag, kind, terms, number), each flag once. Kinds: `title` and `any` ask for one of the terms in the
    title, or in title or ingredients; `none` forbids the terms among the ingredients; `protein`, `calories` and `minutes` compare a
    number. Unknown diets and allergies and texts without a number give no rule. `asked` says whether the document asks for
    anything, known or not. Equal documents are compiled once.
    """
    keyed = df.select(key, F.coalesce(document, F.lit("")).alias("_document"))
    r = F.from_json(F.col("_document"), CONSTRAINTS)
    none, number = F.array().cast("array<string>"), F.lit(None).cast("int")
    rule = lambda flag, kind, terms=none, n=number: F.struct(flag.alias("flag"), F.lit(kind).alias("kind"), terms.alias("terms"), n.alias("number"))
    words = lambda terms: F.array(*[F.lit(t) for t in terms])
    subject = F.nullif(r["subject"], F.lit(""))
    of_title = F.coalesce(*[F.when(subject == s, words(terms)) for s, terms in TITLE_SUBJECTS.items()])
    about = F.when(of_title.isNotNull(), rule(F.lit("subject_match"), "title", of_title)).when(subject.isNotNull(), rule(F.lit("subject_match"), "any", F.array(F.lower(subject))))

    def forbidden(asked: Column, table: dict) -> Column:
        known = F.create_map(*[x for name, (flag, terms) in table.items() for x in (F.lit(name), rule(F.lit(flag), "none", words(terms)))])
        return F.transform(asked, lambda a: F.element_at(known, a))

    digits = lambda x: F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")).try_cast("int")

    def bound(x: Column) -> Column:
        n = digits(x)
        protein = rule(F.concat(F.lit("min_"), n.cast("string"), F.lit("g_protein")), "protein", n=n)
        calories = rule(F.concat(F.lit("max_"), n.cast("string"), F.lit("_calories")), "calories", n=n)
        return F.when(n.isNotNull() & x.contains("protein"), protein).when(n.isNotNull() & ~x.contains("protein") & x.contains("calorie"), calories)

    time = F.nullif(r["time_constraints"], F.lit(""))
    limit = digits(time)
    timed = F.when(time.isin("quick", "fast"), rule(F.lit("quick"), "minutes", n=F.lit(30))).when(time.contains("minutes") & limit.isNotNull(), rule(F.concat(F.lit("under_"), limit.cast("string"), F.lit("_minutes")), "minutes", n=limit))
    lists = {c: F.coalesce(r[c], none) for c in ("dietary_constraints", "allergy_constraints", "nutrition_requirements")}
    every = F.concat(F.array(about), forbidden(lists["dietary_constraints"], DIET_FORBIDS), forbidden(lists["allergy_constraints"], ALLERGY_FORBIDS), F.transform(lists["nutrition_requirements"], bound), F.array(timed))
    asked = subject.isNotNull() | time.isNotNull() | (F.size(F.concat(*lists.values())) > 0)
    compiled = keyed.select("_document").distinct().select("_document", F.coalesce(asked, F.lit(False)).alias("asked"), F.array_distinct(F.filter(every, lambda x: x.isNotNull())).alias("rules"))
    return keyed.join(small(compiled), "_document").select(key, "asked", "rules")


def first_number(nutrition: Column, names: list[str]) -> Column:
    """The first number of the first text that names the nutrient and has a number."""
    named = F.filter(F.coalesce(nutrition, F.array().cast("array<string>")), lambda x: F.lower(x).rlike("|".join(names)) & x.rlike(r"\d"))
    return F.nullif(F.regexp_extract(F.get(named, F.lit(0)), r"(\d+)", 1), F.lit("")).try_cast("int")


def cook_minutes(text: Column) -> Column:
    """Minutes of PT35M or of the first number of any other text."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")


def found_terms(texts: DataFrame, recipe: str, text: str, terms: DataFrame) -> DataFrame:
    """(recipe, found): which of the terms (in lower case) each text contains.

    A text contains a term without blanks if one of its words does, so only distinct words meet the distinct terms; of a term of
    several words the first one is looked for that way, and the text is tested where that was found. One row per text with a hit.
    """
    wanted = terms.select("term").distinct().filter("term <> ''").withColumn("head", F.split("term", r"\s+")[0])
    words = texts.select(recipe, F.lower(text).alias("_t")).withColumn("word", F.explode(F.array_distinct(F.split("_t", r"\s+"))))
    distinct = words.select("word").distinct()
    hits = distinct.join(small(wanted), F.contains(F.col("word"), F.col("head")))
    met = words.join(hits, "word").filter(F.contains(F.col("_t"), F.col("term")))
    return met.groupBy(recipe).agg(F.collect_set("term").alias("found"))


#: Up to so many terms are looked for in each text by itself, without a shuffle of its words.
TERMS_PER_TEXT = 200


def with_found_terms(texts: DataFrame, recipe: str, columns: list[str], terms: DataFrame) -> DataFrame:
    """`texts` with in_<column>, an array of the terms (in lower case) that the column contains. Few terms go to each text; more
    meet the distinct words (`found_terms`)."""
    wanted = terms.select("term").distinct().filter("term <> ''")
    if wanted.limit(TERMS_PER_TEXT + 1).count() > TERMS_PER_TEXT:
        for c in columns:
            texts = texts.join(found_terms(texts, recipe, c, wanted).withColumnRenamed("found", f"in_{c}"), recipe, "left").withColumn(f"in_{c}", F.coalesce(f"in_{c}", F.array().cast("array<string>")))
        return texts
    listed = wanted.agg(F.collect_list("term").alias("_terms"))  # one row, of TERMS_PER_TEXT terms at most
    within = lambda c: F.transform(F.array(F.lower(F.coalesce(c, F.lit("")))), lambda t: F.filter("_terms", lambda x: F.contains(t, x)))[0]
    return texts.crossJoin(F.broadcast(listed)).withColumns({f"in_{c}": within(c) for c in columns}).drop("_terms")


def constraint_flags(candidates: DataFrame, recipes: DataFrame, rules: DataFrame, key: str, recipe: str) -> DataFrame:
    """Each candidate (key, recipe) with `details`, a map from flag to whether the recipe meets it, and `accuracy`, the share of flags
    that are met in percent (one digit, 100 without any flag).

    recipes: recipe, title, ingredients (a text), nutrition (array of texts), cook_time. rules: from `constraint_rules`. Where nothing is asked, details is
    {no_constraints: true} and accuracy is null. A missing number fails. Recipes get the terms they
    hold as an array (`with_found_terms`, bounded by the rules' terms), and each candidate is judged by one join with its recipe and one with its rules.
    """
    terms = rules.select(F.explode("rules").alias("r")).select(F.explode("r.terms").alias("term")).distinct()
    facts = with_found_terms(recipes, recipe, ["title", "ingredients"], terms)
    facts = facts.select(
        recipe, "in_title", "in_ingredients", first_number(F.col("nutrition"), ["protein"]).alias("protein"), first_number(F.col("nutrition"), ["calorie", "kcal"]).alias("calories"), cook_minutes(F.col("cook_time")).alias("minutes")
    )

    def met(r: Column) -> Column:
        some = lambda c: F.arrays_overlap(r["terms"], F.col(c))
        cases = F.when(r["kind"] == "title", some("in_title")).when(r["kind"] == "any", some("in_title") | some("in_ingredients")).when(r["kind"] == "none", ~some("in_ingredients"))
        cases = cases.when(r["kind"] == "protein", F.col("protein") >= r["number"]).when(r["kind"] == "calories", F.col("calories") <= r["number"]).when(r["kind"] == "minutes", F.col("minutes") <= r["number"])
        return F.coalesce(cases, F.lit(False))

    judged = candidates.join(facts, recipe).join(rules.select(key, "asked", "rules"), key)
    judged = judged.withColumn("_flags", F.transform("rules", lambda r: F.struct(r["flag"].alias("flag"), met(r).alias("met"))))
    n, good = F.size("_flags"), F.size(F.filter("_flags", lambda x: x["met"]))
    details = F.when(F.col("asked"), F.map_from_entries("_flags")).otherwise(F.create_map(F.lit("no_constraints"), F.lit(True)))
    accuracy = F.when(F.col("asked"), F.when(n > 0, F.round(100.0 * good / n, 1)).otherwise(100.0))
    return judged.select(*candidates.columns, details.alias("details"), accuracy.alias("accuracy"))


def listing_quality(url_domain: Column, sites: list[str], image: Column) -> Column:
    """100 with a priority site and an image, 80 with the site, 60 with the image, else 40."""
    site = F.coalesce(url_domain.rlike("|".join(s.replace(".", r"\.") for s in sites)), F.lit(False))
    return F.when(site & image, 100.0).when(site, 80.0).when(image, 60.0).otherwise(40.0)


def constraints_met(flags: DataFrame, key: str, constraint: str, met: str, keys: DataFrame | None = None) -> DataFrame:
    """Per key: constraints, those that any row meets, and their share in percent (one digit), 100 without constraints. `keys` adds keys
    without any. Two partial aggregations."""
    per = flags.groupBy(key, constraint).agg(F.max(F.coalesce(F.col(met), F.lit(False)).cast("int")).alias("_met"))
    g = per.groupBy(key).agg(F.count(constraint).alias("identified"), F.sum(F.when(F.col(constraint).isNotNull(), F.col("_met"))).alias("satisfied"))
    g = g if keys is None else keys.select(key).distinct().join(g, key, "left")
    n, ok = F.coalesce("identified", F.lit(0)), F.coalesce("satisfied", F.lit(0))
    return g.select(key, n.alias("identified"), ok.alias("satisfied"), F.when(n > 0, F.round(100.0 * ok / n, 1)).otherwise(100.0).alias("rate"))


def missing_fields(ingredients: Column, image: Column, nutrition: Column, values: int = 4) -> Column:
    """Which of ingredients, image_url and nutrition (with `values` entries at least) a recipe lacks."""
    lacks = lambda array, n: F.coalesce(F.size(array), F.lit(0)) < n
    blank = F.trim(F.coalesce(image, F.lit(""))) == ""
    return F.array_compact(F.array(F.when(lacks(ingredients, 1), "ingredients"), F.when(blank, "image_url"), F.when(lacks(nutrition, values), "nutrition")))
