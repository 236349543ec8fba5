"""Rules of single operators on small tables. Cases marked by hand are those that the rules were written down with."""

import pytest
from larder.functions import domain
from larder.operators import aggregates, filters, lookups, ranking, requirements, scoring, texts, units, upserts
from larder.operators.aggregates import merge_lines
from pyspark.sql import Row
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("5-6", 6.0), ("2 - 3", 3.0), ("1–2", 2.0), ("1/2", 0.5), ("1/4", 0.25), ("2/3", 2 / 3), ("1 1/2", 1.5), ("2 1/4", 2.25), ("2.5", 2.5), (".5", 0.5), ("100", 100.0), ("  3  ", 3.0), ("½", 0.5), ("1½", 1.5), ("1 ⅜", 1.375),
     ("⅝", 0.625), ("⅕", 0.2), ("~2", 2.0), ("about 2", 2.0), ("1 1/2-2 1/2", 2.5), ("1/0", None), ("", None), ("some", None), ("1 2", None), (None, None)],
)
def test_quantity_value(spark, text, want):
    assert one(spark, texts.quantity_value(F.lit(text), "max")) == want


@pytest.mark.parametrize(("text", "want"), [("1-2", 1.5), ("1 1/2-2 1/2", 2.0), ("3", 3.0)])
def test_quantity_midpoint(spark, text, want):
    assert one(spark, texts.quantity_value(F.lit(text), "midpoint")) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("PT1H30M", 90), ("pt2h", 120), ("P1DT2H", 1560), ("PT90S", 1), ("1 hour 30 minutes", 90), ("1 h 30 m", 90), ("1.5 hours", 90), ("45", 45), ("2 hrs", 120), ("ready in 20", 20), ("soon", None), ("", None), (None, None)],
)
def test_duration(spark, text, want):
    assert one(spark, texts.duration_minutes(F.lit(text))) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("2 Cups flour", ("2", "cups", "flour")), ("1 1/2 lbs chicken", ("1 1/2", "lbs", "chicken")), ("1 ½ teaspoons salt", ("1 1/2", "teaspoons", "salt")), ("½ tsp salt", ("1/2", "tsp", "salt")), ("0.25 cup oil", ("0.25", "cup", "oil")),
        ("3 blue bolts", ("1", "count", "3 blue bolts")), ("2-3 slices ham", ("1", "count", "2-3 slices ham")), ("salt", ("1", "count", "salt")), ("  2 cloves  garlic ", ("2", "cloves", "garlic")),
    ],
)
def test_ingredient_line(spark, line, want):
    assert tuple(one(spark, texts.ingredient_line(F.lit(line)))) == want


def test_text_lines(spark):
    rows = spark.createDataFrame([(1, " 2 cups flour \n\n  \nsalt"), (2, None), (3, "")], "id int, t string")
    assert [(r.id, r.pos, r.line) for r in texts.text_lines(rows, "t").orderBy("id", "pos").collect()] == [(1, 0, "2 cups flour"), (1, 1, "salt")]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("1 to 2 Cups flour", ("1-2", "cup", "flour", "", "range")), ("2–3 slices ham", ("2-3", "slice", "ham", "", "range")), ("300g flour", ("300", "gram", "flour", "", "plain")), ("about 2 cups milk", ("2", "cup", "milk", "", "about")),
        ("2 (14 oz) cans tomatoes (diced)", ("2", "can", "tomatoes", "diced", "sized")), ("1 and 1/3 cup sugar", ("1 1/3", "cup", "sugar", "", "mixed")), ("1-1/2 cup oats", ("1 1/2", "cup", "oats", "", "mixed")), (".25 oz yeast", ("0.25", "ounce", "yeast", "", "plain")),
        ("15 graham crackers", ("15", "count", "graham crackers", "", "count")), ("salt to taste", ("1", "count", "salt to taste", "", "whole")), ("• 2½ tbsp. butter", ("2 1/2", "tablespoon", "butter", "", "mixed")), ("1 or 2 cloves garlic", ("1-2", "clove", "garlic", "", "range")),
    ],
)
def test_ingredient_rich(spark, line, want):
    got = texts.ingredient_rich(spark.createDataFrame([(line,)], "line string"), "line").first()
    assert (got["quantity"], got["unit"], got["name"], got["context"], got["form"]) == want


@pytest.mark.parametrize(("unit", "want"), [("c", "cup"), ("C", "cup"), ("tbsp", "tablespoon"), ("teaspoons", "teaspoon"), ("lbs", "pound"), ("oz", "ounce"), ("ml", "milliliter"), ("count", "count"), ("cloves", "clove"), ("Package", "package"), ("Handful", "handful")])
def test_unit_names(spark, unit, want):
    assert texts.normalise_unit(spark.createDataFrame([(unit,)], "u string"), "u").first()["unit"] == want


def test_word_set(spark):
    assert sorted(one(spark, texts.word_set(F.lit("2 cups Freshly chopped red-onion, 1/2 tsp für the Salt of 3 eggs")))) == ["eggs", "freshly", "onion", "red", "salt"]


GRAM_CASES = [
    ("pinch", 1.0, "salt", 0.35, "tiny"), ("dash", 2.0, "x", 1.0, "tiny"), ("lb", 1.0, "beef", 453.59, "weight"), ("Kilograms", 2.0, "rice", 2000.0, "weight"), ("cloves", 3.0, "Garlic", 9.0, "piece"), ("to taste", 5.0, "salt", 5.0, "seasoning"),
    ("count", 2.0, "bell pepper", 2.0, "seasoning"), ("cup", 2.0, "brown sugar", 400.0, "density"), ("cup", 1.0, "broth", 240.0, "water"), ("tbsp", 2.0, "olive oil", 27.5, "density"), ("count", 2.0, "eggs", 100.0, "piece"), ("piece", 1.0, "eggplant", 50.0, "piece"),
    ("count", 1.0, "mystery", 50.0, "piece_default"), ("slices", 3.0, "ham", 300.0, "default"), ("handful", 2.0, "salt", 200.0, "default"), ("liter", 1.0, "stock", 1000.0, "water"), ("drizzle", 1.0, "oil", 5.0, "tiny"), ("count", None, "egg", 50.0, "piece"),
]


def test_grams_by_hand(spark):
    rows = spark.createDataFrame([(k, u, q, n) for k, (u, q, n, *_) in enumerate(GRAM_CASES)], "k int, unit string, quantity double, name string")
    rows = rows.withColumn("portions", F.array().cast("array<struct<unit:string,grams:double>>"))
    got = {r.k: (r.grams, r.gram_source) for r in units.to_grams(rows, units.dictionaries(spark)).collect()}
    assert got == {k: (g, s) for k, (*_, g, s) in enumerate(GRAM_CASES)}


@pytest.mark.parametrize(
    ("name", "quantity", "unit", "want"),
    [("Water", 3.0, "cup", True), ("pinch of salt", 1.0, "cup", True), ("diced ham", 1.0, "cup", False), ("rice", 1.0, "cup", False), ("white pepper", 1.0, "tsp", True), ("white pepper", 3.0, "tsp", False), ("paprika", 1.0, "Tablespoon", True), ("paprika", 2.0, "tbsp", False),
     ("hot dog", 1.0, "count", False), ("red onion", 1.0, "count", False), ("bay leaf", 2.0, "", True), ("ham", 1.0, "Smidgen", True), ("basil", None, "count", True)],
)
def test_negligible(spark, name, quantity, unit, want):
    rows = spark.createDataFrame([(name, quantity, unit)], "name string, quantity double, unit string")
    rows = units.with_facts(rows, units.name_facts(rows, units.dictionaries(spark), "name"), "name")
    assert rows.select(units.negligible(F.col("name"), F.col("quantity"), F.col("unit"), F.col("seasoning"))).first()[0] is want


def test_reference_sanity(spark):
    rows = [("a", 0.0, 10.0, 5.0, 5.0), ("b", None, 1.0, 0.0, 0.0), ("c", 0.0, 0.0, 0.0, 0.0), ("sea salt", 0.0, 0.0, 0.0, 0.0), ("d", 951.0, 1.0, 1.0, 1.0), ("e", 100.0, 1.0, 1.0, 106.0), ("f", 100.0, None, 1.0, 1.0)]
    got = {r.n: (r.calories, r.sane) for r in units.reference_sanity(spark.createDataFrame(rows, "n string, calories double, fat double, protein double, carbs double"), "n").collect()}
    assert got == {"a": (130.0, True), "b": (9.0, True), "c": (0.0, False), "sea salt": (0.0, True), "d": (951.0, False), "e": (100.0, False), "f": (100.0, True)}


@pytest.mark.parametrize(
    ("score", "market", "url", "want"),
    [(0.9, True, "x/front_en.400.jpg", "tier1"), (0.9, True, "x/FRONT.600.jpg", "tier1"), (0.9, True, "x/front.200.jpg", "tier2"), (0.9, True, "invalid/front.400.jpg", "rejected"), (0.7, True, None, "tier2"), (0.5, True, None, "rejected"), (0.5, True, "x.jpg", "tier3"), (0.39, True, "x.jpg", "rejected"), (0.9, None, "x/front.400.jpg", "rejected")],
)
def test_quality_tier(spark, score, market, url, want):
    assert one(spark, scoring.quality_tier(F.lit(score), F.lit(market).cast("boolean"), F.lit(url).cast("string"))) == want


@pytest.mark.parametrize(("n", "main", "scalar", "want"), [(3, "a_1200.jpg", None, 30), (2, "a.jpg", None, 20), (1, "thumb.jpg", None, 10), (1, "1500.jpg", None, 20), (0, None, "large.jpg", 25), (0, None, "x150.jpg", 10), (0, None, "x.jpg", 15), (0, None, "", 0)])
def test_image_points(spark, n, main, scalar, want):
    assert one(spark, scoring.image_points(F.lit(n), F.lit(main).cast("string"), F.lit(scalar).cast("string"))) == want


def test_scores_by_hand(spark):
    lit = F.lit
    assert [one(spark, scoring.speed_score(lit(s))) for s in (12.0, 20.0, 40.0, 50.0, 500.0)] == [100.0, 80.0, 60.0, 45.0, 10.0]
    assert [one(spark, scoring.content_points(lit(i), lit(s))) for i, s in ((5, 3), (9, 2), (3, 2), (2, 9))] == [15, 10, 10, 5]
    full = [lit(True), lit(9), lit(7), lit(3), lit(None).cast("string"), lit(True), lit(True), lit(True)]
    assert one(spark, scoring.item_completeness(*full)) == 100
    assert one(spark, scoring.item_completeness(lit(True), lit(2), lit(1), lit(2), lit(None).cast("string"), lit(False), lit(False), lit(False))) == 30
    assert one(spark, scoring.constraint_accuracy(lit(1), lit(4), lit(""), lit(""))) == 25.0
    assert one(spark, scoring.constraint_accuracy(lit(0), lit(0), lit("spicy Thai egg soup"), lit("Thai soup"))) == 100.0
    assert one(spark, scoring.constraint_accuracy(lit(0), lit(0), lit("a hearty egg stew"), lit("egg stew"))) == 75.0
    assert [one(spark, scoring.time_status(lit(e), lit(s))) for e, s in ((31.0, "priority_only"), (31.0, "mixed"), (30.0, "mixed"), (91.0, "broad"), (31.0, "x"))] == ["exceeded", "approaching_limit", "on_track", "exceeded", "approaching_limit"]
    assert [one(spark, scoring.next_action(lit(e), lit(n))) for e, n in ((61.0, 50), (31.0, 9), (31.0, 10), (5.0, 4), (5.0, 5))] == ["ask_user", "pivot", "continue", "expand", "continue"]
    assert [one(spark, scoring.url_type(lit(t), lit(u))) for t, u in (("Top 10 soups", "x"), ("Soup Recipe", "x"), ("Soup", "https://x/Recipe/1"), ("Soup", "x"))] == ["list", "recipe", "recipe", "other"]


@pytest.mark.parametrize(("url", "want"), [("https://x.org/recipe/soup", True), ("https://x.org/recipes/soup/", True), ("https://x.org/2024/05/soup", True), ("https://x.org/recipes/category/x", False), ("https://x.org/best-soup-recipes", False), ("https://x.org/about/soup-recipe", False), ("https://x.org/soup", False)])
def test_is_recipe_url(spark, url, want):
    assert one(spark, scoring.is_recipe_url(F.lit(url))) is want


def test_link_confidence(spark):
    lit = F.lit
    assert one(spark, scoring.link_confidence(lit("https://x.org/recipe/soup"), lit("Chicken soup"), lit(True), lit("20 Minutes"))) == 7
    assert one(spark, scoring.link_confidence(lit("https://x.org/2024/05/x"), lit("Home"), lit(False), lit(None).cast("string"))) == 0
    assert one(spark, scoring.link_confidence(lit("https://x.org/about"), lit("Chicken soup"), lit(True), lit("minutes"))) == 0


def test_recipe_total_takes_shares(spark):
    parts = [F.lit(1.0), [F.lit(1), F.lit(None), F.lit(0), F.lit(2)], [F.lit("x"), F.lit(" ")], F.lit(True)]
    assert one(spark, scoring.recipe_total(F.lit(True), *parts)) == pytest.approx(0.70 + 0.13 * 0.75 + 0.02 * 0.5 + 0.15)
    assert one(spark, scoring.recipe_total(F.lit(None).cast("boolean"), *parts)) == 0.0


def test_text_rules(spark):
    assert [one(spark, aggregates.brevity_score(F.lit(t))) for t in ("One. Two!", "1. 2. 3.", "a. b. c. d. e.", "a. b. c. d. e. f")] == [1.0, 0.8, 0.4, 0.1]
    assert one(spark, aggregates.clean_score(F.lit("Enjoy!"))) == 1.0
    assert one(spark, aggregates.clean_score(F.lit("Step 1: preheat. See https://x.org"))) == pytest.approx(0.4)


def test_domain_diversity(spark):
    per = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (2, "a", 1), (3, "a", 9), (3, "b", 9), (3, "c", 1), (3, "d", 1)], "s int, d string, n int")
    assert {r.s: r.diversity for r in aggregates.domain_diversity(per, ["s"]).collect()} == {1: 0.5, 2: 1.0, 3: 0.7}


def test_category_default_without_default(spark):
    df = spark.createDataFrame([("x",), ("y",)], "k string")
    known = spark.createDataFrame([("x", "1")], "k string, v string")
    assert {r.k: r.v for r in lookups.with_default(df, known, "k", "v", "default").collect()} == {"x": "1", "y": None}


def test_nutrition_needs_without_a_value_fail(spark):
    needs = spark.createDataFrame([("protein", 30.0, None), ("iron", 1.0, None)], "name string, lo double, hi double")
    values = spark.createDataFrame([("r", "protein", 40.0), ("s", "protein", 40.0), ("s", "iron", 0.5), ("u", "protein", 40.0), ("u", "iron", 2.0)], "k string, name string, value double")
    every = spark.createDataFrame([("r",), ("s",), ("t",), ("u",)], "k string")
    got = {r.k: (r.nutrition_ok, r.nutrition_pct) for r in requirements.nutrition_match(values, needs, "k", every).collect()}
    assert got == {"r": (False, 50.0), "s": (False, 75.0), "t": (False, 0.0), "u": (True, 100.0)}


def test_categorise(spark):
    doc = '{"nutrition":{"iron":{"min":3}},"time_constraints":"Under 20 MIN","allergies":["nuts"],"exclude_ingredients":["egg"],"dietary_restrictions":["Dairy free","raw","halal"],"meal_type":"lunch"}'
    rows = requirements.categorise(spark.createDataFrame([(1, doc), (2, '{"dietary_restrictions":"vegan"}'), (3, "junk"), (4, None)], "k int, d string"), "k", "d").collect()
    assert sorted((r.k, r.kind, r.name, r.lo, r.hi, r.term) for r in rows if r.k == 1) == sorted(
        [(1, "nutrition", "iron", 3.0, None, None), (1, "time", "cook_time", None, 20.0, None), (1, "exclude", "term", None, None, "nuts"), (1, "exclude", "term", None, None, "egg"), (1, "dietary", "term", None, None, "dairy_free"),
         (1, "subjective", "dietary_restriction", None, None, "halal"), (1, "subjective", "meal_type", None, None, "lunch")], key=str) or len([r for r in rows if r.k == 1]) == 7
    assert {(r.kind, r.term) for r in rows if r.k == 1} >= {("exclude", "nuts"), ("exclude", "egg"), ("dietary", "dairy_free"), ("subjective", "halal"), ("subjective", "lunch")}
    assert [(r.kind, r.term) for r in rows if r.k == 2] == [("dietary", "vegan")]
    assert not [r for r in rows if r.k > 2]


def test_query_constraints(spark):
    assert one(spark, requirements.from_query(F.lit("Gluten-Free dinner, 30 protein, 500 calories, 20min, no nuts"))) == ["diet=gluten_free", "protein=30", "calories=500", "minutes=20", "exclude=nuts"]


@pytest.mark.parametrize(("text", "meal", "tags", "want"), [("a Soup", "Lunch", ["gluten_free"], 0.65), ("gluten-free soup", "lunch", ["gluten_free"], 0.925), ("x", "snack", [], 0.3), ("x", None, [], 0.5), ("x", "tea", [], 0.5)])
def test_metadata_confidence(spark, text, meal, tags, want):
    tags = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    assert one(spark, requirements.metadata_confidence(F.lit(text), F.lit(meal).cast("string"), tags)) == pytest.approx(want)


def test_aliases_in_any_case_are_one(spark):
    current = spark.createDataFrame([("egg", 1, 0.9, 3, None)], "alias_text string, ingredient_id long, confidence double, usage_count long, last_used timestamp")
    events = spark.createDataFrame([("Egg", 2, 0.5, 1), ("EGG", 2, 0.5, 2), ("Oil", 7, 0.4, 3)], "alias_text string, ingredient_id long, confidence double, s long").selectExpr("alias_text", "ingredient_id", "confidence", "timestamp_seconds(s) ts", "1L n")
    assert {r.alias_text: (r.ingredient_id, r.usage_count) for r in upserts.learn_aliases(current, events).collect()} == {"egg": (1, 5), "oil": (7, 1)}


def test_first_match_is_by_order(spark):
    names = spark.createDataFrame([("bread flour",), ("eggplant",), ("salt",)], "name string")
    keys = spark.createDataFrame([(0, "flour", 120.0), (1, "bread flour", 127.0), (2, "egg", 50.0), (3, "eggplant", 450.0)], "ordinal int, key string, value double")
    got = {r["name"]: r["value"] for r in lookups.first_match(names, keys, "name").collect()}
    assert got == {"bread flour": 120.0, "eggplant": 50.0, "salt": None}
    longest = {r["name"]: r["value"] for r in lookups.first_match(names, keys, "name", longest=True).collect()}
    assert longest == {"bread flour": 127.0, "eggplant": 450.0, "salt": None}


def test_merge_lines(spark):
    rows = [("olive oil", 1.0, "teaspoon")] * 4 + [("garlic", 2.0, "clove"), ("garlic", 1.0, "clove"), ("salt", 1.0, "count"), ("salt", 1.0, "teaspoon")]
    got = {r["m"]: (r["quantity"], r["unit"]) for r in merge_lines(spark.createDataFrame(rows, "m string, q double, u string"), ["m"], "q", "u").collect()}
    assert got == {"olive oil": ("4", "teaspoon"), "garlic": ("3", "clove"), "salt": ("", "")}


def test_domain(spark):
    urls = ["https://www.A.com/x", "http://b.org:8080", "not a url", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(domain("u")).collect()]
    assert got == ["a.com", "b.org:8080", None, None]


@pytest.mark.parametrize(("size", "per_domain"), [(10, 2), (7, 2), (10, 3), (5, 4), (1, 1)])
def test_interleaved_batches(spark, size, per_domain):
    """Against dealing row by row: every batch goes through the domains from the first on."""
    rows = [Row(q=q, d=None if i % 11 == 5 else f"d{i % (3 + q)}" if i < 40 else f"x{i % 9}", t=i % 11 != 5 and i < 40 and i % (3 + q) == 0, r=i) for q in range(3) for i in range(67)]
    got = {(r.q, r.r): r.batch for r in ranking.interleaved_batches(spark.createDataFrame(rows), "q", "d", "t", "r", size, per_domain).collect()}
    want = {}
    for q in range(3):
        queues = {}
        for x in rows:
            if x.q == q:
                queues.setdefault((not any(y.t for y in rows if y.q == q and y.d == x.d), x.d or ""), []).append(x.r)
        batch = 0
        while any(queues.values()):
            batch, room = batch + 1, size
            for k in sorted(queues):
                take = min(per_domain, len(queues[k]), room)
                want |= {(q, r): batch for r in queues[k][:take]}
                queues[k], room = queues[k][take:], room - take
    assert got == want


def test_nutrient_match_takes_the_smaller_of_both_bounds(spark):
    rows = [("r", "protein", 15.0), ("r", "fat", 40.0), ("s", "protein", None), ("s", "fat", 10.0)]
    needs = spark.createDataFrame([("protein", 30.0, None), ("fat", 5.0, 20.0)], "name string, lo double, hi double")
    got = {r["k"]: (r["nutrition_ok"], r["nutrition_pct"]) for r in requirements.nutrition_match(spark.createDataFrame(rows, "k string, name string, value double"), needs, "k").collect()}
    assert got == {"r": (False, 50.0), "s": (False, 50.0)}


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_stream_and_batch_rate_limit_agree(spark, sf_dir, batch):
    from larder.plans.registry import QUERIES
    from larder.streaming import rate_limit_batch

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        stream = {(r.user_id, r.event_id, r.admitted) for r in QUERIES["stm_rate_limit"](spark, sf_dir).collect()}
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        by_table = {(r.user_id, r.event_id, r.admitted) for r in rate_limit_batch(events, 2, 6 * 3600).collect()}
    finally:
        spark.conf.set(key, before)
    assert stream == by_table
    assert any(a for *_, a in by_table) and not all(a for *_, a in by_table)


def test_required_gate_reads_the_whole_text(spark, tmp_path):
    from larder.plans.registry import QUERIES

    docs = spark.createDataFrame([(1, " " * 80 + "flour and water", "src1", 95), (2, " " * 95, "src1", 95)], "doc_id long, text string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["passed"] for r in QUERIES["scr_required_gate"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: False}


def test_tsv_lines_that_are_too_short_too_long_or_mistyped(spark, tmp_path):
    from larder import sources

    (tmp_path / "t.tsv").write_text("code\tname\tsize\n1\ta\t5\n2\tb\n3\tc\t7\textra\n4\td\tmany\n5\te\t9\n")
    got = {r["code"]: (r["size"], r["bad_line"] is None) for r in sources.tsv_bad_lines(spark, str(tmp_path / "t.tsv"), ["code", "name", "size"], {"size": "int"}).cache().collect()}
    assert got == {"1": (5, True), "2": (None, False), "3": (7, False), "4": (None, False), "5": (9, True)}


def test_spread_deals_a_small_file_only(spark, sf_dir):
    from larder.sources import spread

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(docs, 10)._jdf.equals(docs._jdf) or spread(docs, 10) is docs


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["Calories300Protein25g"], {"calories": 300.0, "protein": 25.0}), (["334 kcal", "19g protein", "26 g carbohydrates", "Total Fat: 17g"], {"calories": 334.0, "protein": 19.0, "carbs": 26.0, "fat": 17.0}),
        (["Amount per serving", "Energy: 90", "3.5 grams protein", "12 g sugars", "Fiber: 4", "250mg sodium"], {"calories": 90.0, "protein": 3.5, "fiber": 4.0, "sugar": 12.0, "sodium": 250.0}), (["400g protein"], {}), (["9 calories"], {}), ([], {}),
    ],
)
def test_nutrition_values(spark, lines, want):
    got = spark.range(1).select(*texts.nutrition_values(F.array(*[F.lit(x) for x in lines]).cast("array<string>"))).first().asDict()
    assert {k: v for k, v in got.items() if v is not None} == want


# --- spaces, measures, labels and steps of ingredient texts; cases by hand ---


@pytest.mark.parametrize(
    ("text", "want"),
    [("6Tbsp. butter", "6 Tbsp butter"), ("½cup sugar", "½ cup sugar"), ("1/2Cup milk", "1/2 Cup milk"), ("1 ½cups milk", "1 ½ cups milk"), ("3large eggs", "3 large eggs"), ("2extra", "2 extra"), ("8ounces ham", "8 ounces ham"), ("1 Tbspheavy cream", "1 Tbsp heavy cream"),
     ("2 cupsFlour", "2 cups Flour"), ("11/2cups rice", "1 1/2 cups rice"), ("10 garlic cloves", "10 garlic cloves"), ("1 (8 oz)package", "1 (8 oz) package"), ("2  cups   oil ", "2 cups oil"), ("1 oz.Butter", "1 oz Butter"), ("6.5oz tuna", "6.5 oz tuna"), ("cupsugar", "cup sugar"),
     ("111/2 cups", "111/2 cups"), ("", ""), (None, None), ("salt & pepper", "salt & pepper")],
)
def test_spacing_repair(spark, text, want):
    assert one(spark, texts.spacing_repair(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("400g/14oz canned corn (sub frozen 1 3/4 cups)", ["1 3/4 cup", "14 ounce", "400 gram"]), ("½ cup", ["½ cup"]), ("2-3 cups or 2 - 3 C.", ["2-3 cup", "2 - 3 cup"]), ("1 3/4 cups", ["1 3/4 cup"]), ("250g/1pkg, 100g/4oz", ["4 ounce", "250 gram", "100 gram", "1 pkg"]),
     ("2 lbs or 2 pounds", ["2 pound"]), ("1.5 kg", ["1.5 kilogram"]), ("2 TBS", ["2 tablespoon"]), ("three eggs", []), ("", [])],
)
def test_alternative_units(spark, text, want):
    assert [f"{x.quantity} {x.unit}" for x in one(spark, texts.alternative_units(F.lit(text)))] == want


@pytest.mark.parametrize(("name", "want"), [("large egg", False), ("head of garlic", False), ("cupcake", True), ("2 eggs", True), ("OZ", True), ("", False), (None, False)])
def test_suspect_parse(spark, name, want):
    assert one(spark, texts.suspect_parse(F.lit("1"), F.lit("count"), F.lit(name).cast("string"))) is want
    assert one(spark, texts.suspect_parse(F.lit("2"), F.lit("count"), F.lit(name).cast("string"))) is False


@pytest.mark.parametrize(("text", "want"), [("butter, Softened", True), ("salt or pepper", False), ("salt to taste", True), ("mint if desired", True), ("x" * 31, True), ("x" * 30, False), (None, False)])
def test_complex_line(spark, text, want):
    assert one(spark, texts.complex_line(F.lit(text).cast("string"))) is want


@pytest.mark.parametrize(("text", "want"), [("Soup\n1. boil\n3.\n\n  2.  eat ", ("Soup", ["boil", "eat"])), ("  \n", ("Untitled Recipe", [])), (None, ("Untitled Recipe", [])), ("Only", ("Only", []))])
def test_directions(spark, text, want):
    r = one(spark, texts.directions(F.lit(text).cast("string")))
    assert (r.title, r.steps) == want


def stop_by_hand(rows, min_good=3, max_good=5, cap=15):
    """Rows kept of (tried, ok, passed, good) in order, by a loop."""
    n = n_ok = n_good = 0
    kept = []
    for k, (tried, ok, passed, good) in enumerate(rows[:cap]):
        if not tried:
            continue
        n += 1
        kept.append(k)
        if not ok:
            continue
        n_ok += 1
        if not passed:
            continue
        if good:
            n_good += 1
            if n_good >= max_good or n_good >= min_good and n >= 8 and n_ok / n >= 0.6 and n_good / n_ok >= 0.4:
                break
        if n >= 10 and n_ok / n < 0.3:
            break
    return kept


def test_early_exit_against_a_loop(spark):
    import random

    rng = random.Random(4)
    cases = {q: [tuple(rng.random() < p for p in rng.choice([(0.95, 0.8, 0.8, 0.6), (1, 0.25, 0.9, 0.1), (0.9, 0.7, 0.9, 0.4)])) for _ in range(rng.randint(1, 20))] for q in range(300)}
    cases[1000] = [(True, k in {0, 1, 2, 3, 5, 7}, True, k in {1, 3, 7}) for k in range(12)]  # 6 parsed, 3 good at the eighth row
    data = [(q, k, *map(bool, r)) for q, rows in cases.items() for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, "q long, k long, tried boolean, ok boolean, passed boolean, good boolean")
    kept = ranking.early_exit(df, "q", "k", F.col("ok"), F.col("passed"), F.col("good"), F.col("tried")).collect()
    got = {q: sorted(r.k for r in kept if r.q == q) for q in cases}
    assert got == {q: stop_by_hand(rows) for q, rows in cases.items()}
    assert len(got[1000]) == 8


# --- macros, reports and evaluators; cases by hand ---


def test_merge_lines_without_quantity_or_unit(spark):
    rows = [("a", "2", "cup"), ("a", "3", None), ("a", "1", "cup"), ("a", "", "cup"), ("b", "1", "cup"), ("b", "2.25", "cup"), ("c", "some", "cup"), ("c", "1", "cup"), ("d", "3", ""), ("e", "1", "cup"), ("e", None, "gram")]
    got = {r.m: (r.quantity, r.unit, r.n_lines) for r in merge_lines(spark.createDataFrame(rows, "m string, q string, u string"), ["m"], "q", "u").collect()}
    assert got == {"a": ("3", "cup", 4), "b": ("3.25", "cup", 2), "c": ("", "", 2), "d": ("", "", 1), "e": ("1", "cup", 2)}


def test_negligible_lines_and_source_mix(spark):
    rows = [("r", "portion", 10.0, False), ("r", "water", 5.0, True), ("r", "water", 5.0, False), ("r", "estimate", 5.0, False), ("r", "piece", 5.0, False), ("r", "piece_default", 5.0, False), ("r", "default", 5.0, False), ("r", "weight", 5.0, False), ("s", "seasoning", 1.0, False)]
    lines = units.without_negligible(spark.createDataFrame(rows, "k string, gram_source string, grams double, flag boolean"), F.col("flag"))
    assert sorted(r.grams for r in lines.filter("k = 'r'").collect())[:2] == [0.0, 5.0]
    got = {r.k: r.mix for r in units.source_mix(lines, "k").collect()}
    # shares of one eighth are 12.5, rounded half to even
    assert got == {"r": "USDA_PORTION:12%,TABLE:12%,LLM_ESTIMATE:12%,WATER:12%,ESTIMATE:25%,DIRECT:12%,NEGLIGIBLE:12%", "s": "SEASONING_DEFAULT:100%"}


@pytest.mark.parametrize(
    ("name", "want"),
    [("Eggs", "egg whole raw"), (" EGG ", "egg whole raw"), ("raw egg", "raw egg"), ("Butter", "butter salted"), ("boiled potato", "boiled potato"), ("Fried eggs, boiled", "Fried eggs, boiled"), ("eggs raw", "eggs raw"), ("Brown Sugar", "sugars brown"), ("Strawberry", "Strawberry"), ("rice", "rice")],
)
def test_search_terms(spark, name, want):
    assert lookups.search_terms(spark.createDataFrame([(name,)], "name string"), "name").first().search_term == want


def test_search_terms_of_a_table(spark):
    df, mapping = spark.createDataFrame([("Cooked Oats",), ("oats",)], "name string"), spark.createDataFrame([("Cooked oats", "oats"), (" OATS", "oats dry")], "common string, canonical string")
    assert sorted(r.search_term for r in lookups.search_terms(df, "name", mapping).collect()) == ["oats cooked", "oats dry"]


def test_session_totals(spark):
    rows = [(1, 1, "Calories", "350 kcal"), (1, 1, "Protein", "~20.5g"), (1, 2, "calories from fat", "10"), (1, 2, "Trans Fat", "1.2.3"), (1, 2, "Net Carbs", 7), (1, 3, None, None), (2, 9, "Fibre", "3")]
    got = {r.s: r for r in aggregates.session_totals(spark.createDataFrame([(a, b, c, None if d is None else str(d)) for a, b, c, d in rows], "s long, m long, name string, amount string"), "s", "m", "name", "amount").collect()}
    assert (got[1].meals, got[1].calories, got[1].protein, got[1].fat, got[1].carbs, got[1].calories_per_meal) == (3, 360.0, 20.5, 0.0, 7.0, 120.0)
    assert (got[2].meals, got[2].calories) == (1, 0.0)


@pytest.mark.parametrize(("message", "want"), [("HTTP 403", "crawl_blocked"), ("Forbidden", "crawl_blocked"), ("Timeout!", "timeout"), ("timed out", "other"), ("No recipe data found", "no_data"), ("no data", "other"), ("blocked", "other"), (None, "other")])
def test_error_class(spark, message, want):
    assert one(spark, aggregates.error_class(F.lit(message).cast("string"))) == want


def test_parse_quality_is_graded_by_the_exact_rate(spark):
    data = [(k, s) for k, (ok, bad, rest) in {"a": (799, 201, 5), "b": (4, 1, 0), "c": (3, 2, 9), "d": (2, 3, 0), "e": (0, 1, 0), "f": (0, 0, 2)}.items() for s in ["ok"] * ok + ["bad"] * bad + ["?"] * rest]
    df = spark.createDataFrame(data, "k string, s string")
    got = {r.k: (r.success_rate, r.quality) for r in aggregates.parse_quality(df, ["k"], F.col("s") == "ok", F.col("s") == "bad", F.lit(False)).collect()}
    assert got == {"a": (0.8, "good"), "b": (0.8, "excellent"), "c": (0.6, "good"), "d": (0.4, "acceptable"), "e": (0.0, "poor"), "f": (0.0, "none")}


def test_queue_status(spark):
    rows = [("a", "queued"), ("a", "queued"), ("a", "processing"), ("b", "processing"), ("c", "failed")]
    got = {r.u: (r.depth, r.running, r.active_slots, r.free_slots, r.active_users) for r in aggregates.queue_status(spark.createDataFrame(rows, "u string, s string"), "u", "s").collect()}
    assert got == {"a": (2, True, 2, 20, 3), "b": (0, True, 2, 20, 3), "c": (0, False, 2, 20, 3)}


@pytest.mark.parametrize(
    ("seconds", "difficulty", "want"),
    [(10.5, "easy", 1.0), (10.6, "easy", 0.8), (31.4, "easy", 0.5), (31.6, "easy", 0.2), (15.0, "medium", 1.0), (30.0, None, 0.8), (45.0, "odd", 0.5), (45.1, "medium", 0.2), (22.5, "hard", 1.0), (67.5, "hard", 0.5), (None, "hard", 0.0)],
)
def test_latency_score(spark, seconds, difficulty, want):
    assert one(spark, aggregates.latency_score(F.lit(seconds).cast("double"), F.lit(difficulty).cast("string"))) == want


@pytest.mark.parametrize(("failed", "found", "expected", "want"), [(True, 9, 5, 0.0), (False, 0, 5, 0.0), (False, 5, None, 1.0), (None, 2, None, 0.4), (False, 2, 8, 0.25), (False, 9, 8, 1.0)])
def test_success_score(spark, failed, found, expected, want):
    assert one(spark, aggregates.success_score(F.lit(failed).cast("boolean"), F.lit(found), F.lit(expected).cast("int"))) == want


@pytest.mark.parametrize(("expected", "errors", "unusual", "classified", "want"), [(True, 0, 0, False, 0.5), (True, 2, 2, True, 1.0), (True, 2, 1, False, 0.3), (False, 0, 0, False, 1.0), (False, 2, 1, True, 0.1), (False, 2, 0, True, 0.8)])
def test_error_score(spark, expected, errors, unusual, classified, want):
    assert one(spark, aggregates.error_score(F.lit(expected), F.lit(errors), F.lit(unusual), F.lit(classified))) == want


@pytest.mark.parametrize(
    ("request_", "searched", "want"), [("Save meal #2", True, 0.0), ("save the quick one", False, 1.0), ("save recipe 3", False, 1.0), ("find soup", True, 1.0), ("find soup", False, 0.2)]
)
def test_save_score(spark, request_, searched, want):
    assert one(spark, aggregates.save_score(F.lit(request_), F.lit(searched))) == want


@pytest.mark.parametrize(
    ("answer", "fallback", "exact", "want"),
    [("two, plus some more", True, 1, 1.0), ("two", True, 1, 0.3), ("These are the best matches available", True, 0, 1.0), ("two", True, 0, 0.2), ("I found some", False, 2, 1.0), ("I found some that might do", False, 2, 0.6), ("here", False, 2, 0.6)],
)
def test_fallback_score(spark, answer, fallback, exact, want):
    assert one(spark, aggregates.fallback_score(F.lit(answer), F.lit(fallback), F.lit(exact))) == want


def test_score_trend_and_closest(spark):
    rows = [("a", 1, 5.0), ("a", 2, 5.5), ("b", 1, 3.0), ("b", 2, 2.9), ("c", 1, 1.0), ("c", 2, 1.0), ("d", 1, 1.0), ("e", 1, None)]
    got = {r.k: r.trend for r in ranking.score_trend(spark.createDataFrame(rows, "k string, t int, s double"), "k", ["t"], "s").collect()}
    assert got == {"a": "improving", "b": "declining", "c": "stable", "d": "insufficient_data", "e": "insufficient_data"}
    pct = spark.createDataFrame([("q", k, p) for k, p in enumerate([0.0, 30.0, 90.0, 90.0, 10.0])] + [("z", 1, 0.0), ("y", 1, 5.0)], "q string, k int, p double")
    assert sorted((r.q, r.k) for r in ranking.closest(pct, "q", "k", "p").collect()) == [("q", 1), ("q", 2), ("q", 3), ("y", 1)]


def test_excluded_urls_leave_their_site(spark):
    pages = spark.createDataFrame([("https://a.com/1",), ("https://a.com/2",), ("https://x.bad.org/3",), ("https://b.org",), (None,)], "url string")
    blocked, excluded = spark.createDataFrame([("bad.org",)], "site string"), spark.createDataFrame([("https://a.com/1",)], "url string")
    assert sorted(r.url for r in filters.unblocked(pages, "url", blocked, excluded).collect()) == ["https://a.com/2", "https://b.org"]


@pytest.mark.parametrize(
    ("quantity", "unit", "name", "disqualified", "optional", "want"),
    [("2", "cup", "rice", False, False, True), ("2", "cup", "rice", None, None, True), ("", "cup", "rice", False, False, False), ("2", None, "rice", False, False, False), ("2", "cup", "", False, False, False), ("2", "cup", "rice", True, False, False), ("2", "cup", "rice", False, True, False), ("0", "cup", "rice", False, False, False)],
)
def test_cart_eligible(spark, quantity, unit, name, disqualified, optional, want):
    lit = lambda x, t: F.lit(x).cast(t)
    assert one(spark, filters.cart_eligible(lit(quantity, "string"), lit(unit, "string"), lit(name, "string"), lit(disqualified, "boolean"), lit(optional, "boolean"))) is want


# --- constraints and references; cases by hand ---


def test_constraint_flags(spark):
    documents = {
        1: '{"subject": "cheesecake", "dietary_constraints": ["vegan", "paleo"], "nutrition_requirements": ["min_protein_20g", "protein"], "time_constraints": "quick"}',
        2: '{"subject": "Chicken Soup", "allergy_constraints": ["nuts", "eggs", "dust"], "nutrition_requirements": ["max_calories_300", "max_calories_300"]}',
        3: '{"dietary_constraints": ["paleo"]}',
        4: '{"subject": ""}',
        5: "no document",
        6: '{"subject": "chocolate cake", "time_constraints": "under_30_minutes", "dietary_constraints": ["gluten-free", "dairy-free", "keto"], "allergy_constraints": ["shellfish"]}',
    }
    recipes = [
        (1, "Classic CHEESECAKE", "Cream cheese and eggplant", ["Energy", "Protein: 25.5 g"], "PT35M"),
        (2, "Soup of the day", "a chicken soup cube, doughnuts", ["calories 300 kcal"], "20 minutes"),
        (3, "Chicken  Soup", None, None, None),
        (4, None, "rice flour, Shrimps", ["kcal", "250 kcal"], ""),
    ]
    rules = requirements.constraint_rules(spark.createDataFrame(list(documents.items()), "q long, document string"), "q", "document")
    table = spark.createDataFrame(recipes, "r long, title string, ingredients string, nutrition array<string>, cook_time string")
    pairs = spark.createDataFrame([(q, r[0]) for q in documents for r in recipes], "q long, r long")
    got = {(x.q, x.r): (x.details, x.accuracy) for x in requirements.constraint_flags(pairs, table, rules, "q", "r").collect()}
    assert len(got) == 24
    assert got[1, 1] == ({"subject_match": True, "vegan": False, "min_20g_protein": True, "quick": False}, 50.0)
    assert got[1, 3] == ({"subject_match": False, "vegan": True, "min_20g_protein": False, "quick": False}, 25.0)
    assert got[2, 2] == ({"subject_match": True, "nuts_excluded": False, "eggs_excluded": True, "max_300_calories": True}, 75.0)
    assert got[2, 3] == ({"subject_match": False, "nuts_excluded": True, "eggs_excluded": True, "max_300_calories": False}, 50.0)
    assert got[2, 1][0]["eggs_excluded"] is False and got[2, 4][0]["max_300_calories"] is True
    assert got[3, 1] == ({}, 100.0)
    assert got[4, 1] == got[5, 4] == ({"no_constraints": True}, None)
    assert got[6, 4] == ({"subject_match": False, "gluten_free": False, "dairy_free": True, "keto": False, "shellfish_excluded": False, "under_30_minutes": False}, 16.7)
    assert got[6, 1][0]["subject_match"] is True and got[6, 2][0]["under_30_minutes"] is True


def test_constraints_met(spark):
    rows = [(1, "a", True), (1, "a", False), (1, "b", False), (1, "c", None), (2, "a", True)]
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    got = {r.k: (r.identified, r.satisfied, r.rate) for r in requirements.constraints_met(spark.createDataFrame(rows, "k long, c string, m boolean"), "k", "c", "m", keys).collect()}
    assert got == {1: (3, 1, 33.3), 2: (1, 1, 100.0), 3: (0, 0, 100.0)}


def test_missing_fields(spark):
    lit = lambda x: F.lit(None).cast("array<string>") if x is None else F.array(*[F.lit(v) for v in x]).cast("array<string>")
    case = lambda i, m, n: one(spark, requirements.missing_fields(lit(i), F.lit(m).cast("string"), lit(n)))
    assert case(["a"], "http://x", list("abcd")) == []
    assert case(None, " ", list("abc")) == case([], None, None) == ["ingredients", "image_url", "nutrition"]


@pytest.mark.parametrize(
    ("said", "title", "position", "minutes", "want"),
    [("the soup", "Tomato SOUP", 2, 90, 0.5), ("first", "x", 1, None, 1.0), ("recipe #2", "x", 1, None, 0.0), ("third", "x", 3, None, 1.0), ("the last one", "x", 3, None, 0.8), ("the last one", "x", 2, None, 0.0), ("quick", "x", 1, 30, 0.7), ("quick", "x", 1, 0, 0.0), ("quick", "x", 1, 31, 0.0),
     ("scottish", "Scottish pie", 1, None, 1.0), ("an asian one", "Asian", 9, None, 1.0), ("pie", "Pie", 1, None, 0.0), (None, None, None, None, 0.0)],
)
def test_reference_match(spark, said, title, position, minutes, want):
    c = scoring.reference_match(F.lit(said).cast("string"), F.lit(title).cast("string"), F.lit(position).cast("int"), F.lit(minutes).cast("int"))
    assert one(spark, c) == want


# --- links, blocks, fuzzy names and relevance ---


@pytest.mark.parametrize(
    ("base", "href"),
    [("http://a.org/b/c?x=1", h) for h in ("page.html", "../x", "./y/../z", "//host/p", "/root", "?q=2", "#top", "https://o.net/x", "../../../up", "..", ".", "d/", "mailto:x@y", "a/b?c=/../d")] + [("http://a.org", "x"), ("http://a.org/b/", "x"), ("https://www.a.org/b/c/d", "../e.html#f")],
)
def test_absolute_url(spark, base, href):
    from urllib.parse import urljoin

    assert one(spark, texts.absolute_url(F.lit(base), F.lit(href))) == urljoin(base, href)


def test_page_links(spark):
    html = """<a class="x" data-href="no" href='/recipe/pie'>Apple <i>pie</i></a><A HREF=soup-recipe >  Soup &amp; more </A><a href="/recipe/egg">Egg</a><a href="/recipes/category/x/">Categories</a><a>None here</a><a href="">Empty one</a><a href="/recipe/pie">Apple pie</a>"""
    got = texts.page_links(spark.createDataFrame([(1, "http://s.org/a/b", html), (2, "http://s.org", None)], "p int, u string, h string"), "p", "u", "h").collect()
    assert sorted((r.p, r.link, r.label) for r in got) == [(1, "http://s.org/a/soup-recipe", "Soup & more"), (1, "http://s.org/recipe/pie", "Apple pie")]


def test_page_jsonld_shapes(spark):
    block = lambda *bodies: "".join(f'<script type="application/ld+json">{b}</script>' for b in bodies)
    pages = {
        1: block('["text", 5, {"@type": "Recipe", "name": "A", "recipeIngredient": "salt", "image": [], "recipeYield": [], "nutrition": "x"}]'),
        2: block('{"@type": "Recipe", "name": "no ingredients", "recipeIngredient": []}', '{"@type": ["Recipe"], "name": "B", "recipeIngredient": ["x", "", 3], "image": ["i1", "i2"], "recipeInstructions": []}'),
        3: block('{"name": "no type", "recipeIngredient": ["x"]}', "{broken", ""),
        4: "<script>var x = 1</script>",
        5: None,
    }
    got = {r.p: r for r in texts.page_jsonld(spark.createDataFrame(list(pages.items()), "p int, h string"), "p", "h").collect()}
    assert set(got) == {1, 2}
    assert (got[1].title, got[1].ingredients, got[1].instructions, got[1].nutrition, got[1].servings, got[1].image_url) == ("A", ["salt"], [], [], "", "")
    assert (got[2].title, got[2].ingredients, got[2].image_url) == ("B", ["x"], "i1")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("least", [70.0, 50.0, 34.0, 100.0])
def test_fuzzy_variants_against_all_pairs(spark, least):
    import random

    rng = random.Random(6)
    word = lambda a, b: "".join(rng.choice("abcd ") for _ in range(rng.randint(a, b)))
    targets = sorted({word(1, 9) for _ in range(40)} | {"", "abcabcabc"})
    names = [word(0, 14) for _ in range(250)] + [t.upper() + "x" for t in targets[:20]] + [None]
    want = {}
    for t in targets:
        for o in names:
            o = (o or "").lower()
            if not t or not o:
                continue
            best = min(levenshtein(t, o[k : k + len(t)]) for k in range(max(len(o) - len(t), 0) + 1))
            if round(100 * (1 - best / len(t)) + 1e-9, 2) >= least:
                n, variants = want.get(t, (0, set()))
                want[t] = (n + 1, variants | {o})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    found = lookups.fuzzy_variants(df, spark.createDataFrame([(t,) for t in targets], "target string"), "name", least)
    assert {r.target: (r.total, set(r.variants)) for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_query_relevance_against_all_pairs(spark):
    import random

    rng = random.Random(8)
    vocabulary = ["egg", "eggplant", "an", "a", "banana", "rice", "price", "ham", "chamber", "tea", "x" * 30]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, n)))
    items = [(k, some(5).split(), some(9), some(3) or None, rng.choice(["tea", "en", None]), rng.choice([0.0, 0.05, 0.21, 0.5, 0.9])) for k in range(120)]
    queries = [(k, sorted(set(some(6).split()))) for k in range(30)] + [(99, ["nowhere", "egg"]), (100, [])]
    contained = lambda words, text: sum(w in (text or "") for w in words) / len(words)
    want = {}
    for i, title, body, text, category, need in items:
        for q, words in queries:
            score = 0.5 if not words else min(1.0, round(0.4 * len(set(words) & set(title)) / len(words) + 0.3 * contained(words, body) + 0.2 * contained(words, text) + 0.1 * contained(words, category), 6))
            if score >= need:
                want[i, q] = score
    df = spark.createDataFrame(items, "i long, title array<string>, body string, text string, category string, need double")
    qs = spark.createDataFrame(queries, "query_id long, words array<string>")
    got = {(r.i, r.query_id): r.relevance for r in scoring.query_relevance(df, qs, "i", "title", "body", "text", "category", F.col("need")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    high = scoring.query_relevance(df, qs, "i", "title", "body", "text", "category", 0.6).collect()
    everything = scoring.query_relevance(df, qs, "i", "title", "body", "text", "category", 0.0).collect()
    assert len(everything) == len(items) * len(queries)
    assert {(r.i, r.query_id) for r in high} == {(r.i, r.query_id) for r in everything if r.relevance >= 0.6}


@pytest.mark.parametrize(
    ("text", "want"),
    [("5-6", "6"), ("1/2", "0.5"), ("1 1/2", "1.5"), ("5", "5"), (" 2 - 1/2 ", "2"), ("1 1/2-3", "3"), ("4/2", "2"), ("1/0", "1/0"), ("1-1/0", "1-1/0"), ("1.5-2", "1.5-2"), ("½", "½"), ("a pinch", "a pinch"), ("", ""), (None, ""), ("2-a", "2-a")],
)
def test_quantity_text(spark, text, want):
    assert one(spark, texts.quantity_text(F.lit(text).cast("string"))) == want


def test_standard_and_enhanced_record(spark):
    schema = "title string, lines array<struct<id:string,name:string,quantity:string,unit:string>>, steps array<struct<step_number:int,text:string,type:string,meta_step_section:string>>, uses map<int,array<string>>, meta array<struct<name:string,quantity:string,unit:string>>, facts struct<calories:string,fat:string,carbs:string,protein:string>"
    lines = [("ing_1", "flour", "1 1/2", "C"), ("ing_2", "salt", None, " Pinch "), ("ing_3", None, "2-3", None)]
    rows = [("Bread", lines, [(1, "Mix.", "step", "Dough"), (2, "Bake.", "step", None)], {1: ["ing_1", "ing_2"]}, [("flour", "3/2", "cups")], ("120", None, "20", "4")), (None, None, [], {}, [], None)]
    df = spark.createDataFrame(rows, schema)
    plain = filters.standard_record(F.col("title"), F.lit("Site"), F.col("lines"), F.transform("steps", lambda x: x["text"]), F.lit("u"), nutrition=F.col("facts"))
    rich = filters.enhanced_record(F.col("title"), F.lit("Site"), F.col("lines"), F.col("steps"), F.col("uses"), F.lit("u"), F.col("meta"), servings=F.when(F.col("title").isNotNull(), 4), nutrition=F.col("facts"))
    (full, rich_full), (empty, rich_empty) = df.select(plain.alias("a"), rich.alias("b")).collect()
    assert list(full.asDict()) == ["title", "parser_method", "meal_occasion", "total_time", "ingredients", "directions", "nutrition", "image", "source_url"]
    assert [(x.name, x.quantity, x.unit) for x in full.ingredients] == [("flour", "1.5", "cup"), ("salt", "", "pinch"), ("", "3", "")]
    assert full.directions == ["Mix.", "Bake."] and full.nutrition.asDict() == {"calories": "120", "fat": "", "carbs": "20", "protein": "4"}
    assert (full.meal_occasion, full.total_time, full.image, full.source_url) == ("Other", "", "", "u")
    assert (empty.title, empty.ingredients, empty.directions, set(empty.nutrition)) == ("", [], [], {""})
    assert [x.id for x in rich_full.ingredients] == ["ing_1", "ing_2", "ing_3"] and rich_full.servings == 4
    assert [(x.step_number, x.ingredient_ids) for x in rich_full.directions] == [(1, ["ing_1", "ing_2"]), (2, [])]
    assert [tuple(x) for x in rich_full.meta_ingredients] == [("flour", "1.5", "cup")]
    assert (rich_empty.servings, rich_empty.directions, rich_empty.meta_ingredients) == (0, [], None)


def test_minimal_view_of_a_long_recipe(spark):
    df = spark.createDataFrame([("a", k, 100 - k, k % 3 == 0) for k in range(20)] + [("b", 1, 5, None)], "r string, n int, item int, exact boolean")
    got = {r.r: (r.ingredients, r.exact_count, r.closest_count) for r in filters.minimal_view(df, "r", ["n"], "item", F.col("exact")).collect()}
    assert got == {"a": ([100 - k for k in range(8)], 7, 13), "b": ([5], 0, 1)}


def test_query_relevance_meets_words_without_a_shuffle_of_pairs(spark):
    text = "  abcdefghijk\tlmn ééü "
    parts = {text[a:b] for a in range(len(text)) for b in range(a + 1, len(text) + 1)}
    assert set(one(spark, scoring.word_grams(F.lit(text)))) == {x for x in parts if len(x) <= scoring.GRAM and not any(c.isspace() for c in x)}
    assert one(spark, scoring.word_grams(F.lit(None).cast("string"))) == []
    items = spark.createDataFrame([(1, ["ab"], text, "t", "c", "x")], "i long, title array<string>, body string, text string, category string, more string")
    queries = spark.createDataFrame([(7, ["abcdefghij", "bcdefghijl", "ab"])], "query_id long, words array<string>")
    found = scoring.query_relevance(items, queries, "i", "title", "body", "text", "category", 0.2, keep=["more"])
    # items are dealt by their key once, and nothing after that
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 7, 0.333333, "x")]


def test_texts_are_searched_once(spark):
    """No step's text is written out again for each of its uses."""
    df = spark.createDataFrame([("Calories 90Protein 7gFat 300 g 3 g fat 2 cups",)], "t string").withColumn("made", F.concat("t", F.lit(" x")))
    searches = lambda found: found._jdf.queryExecution().optimizedPlan().toString().count("regexp_")
    values = df.select(*texts.nutrition_values(F.array("made")))
    assert values.first()[:3] == (90.0, 7.0, None)
    assert searches(values) <= 400
    assert searches(df.select(texts.alternative_units("made").alias("m"))) <= len(texts.MEASURES) + 5
    assert searches(texts.ingredient_rich(df, "made")) <= 12
    assert searches(df.select(texts.quantity_text(F.col("made")).alias("m"))) <= 10


@pytest.mark.parametrize("most", [0, 200])
def test_terms_are_found_in_each_text(spark, monkeypatch, most):
    """Few terms need no join with the words of the texts; more give the same."""
    monkeypatch.setattr(requirements, "TERMS_PER_TEXT", most)
    df = spark.createDataFrame([(1, "Chicken  soup", "2 EGGS"), (2, None, "nutmeg egg"), (3, "", "rice")], "r long, title string, ingredients string")
    terms = spark.createDataFrame([("egg",), ("nut",), ("chicken  soup",), ("egg",), ("",)], "term string")
    found = requirements.with_found_terms(df, "r", ["title", "ingredients"], terms)
    got = {r.r: (sorted(r.in_title), sorted(r.in_ingredients)) for r in found.collect()}
    assert got == {1: (["chicken  soup"], ["egg"]), 2: ([], ["egg", "nut"]), 3: ([], [])}
    assert ("Generate" in found._jdf.queryExecution().optimizedPlan().toString()) == (most == 0)


def test_equal_constraint_documents_are_compiled_once(spark):
    df = spark.createDataFrame([(1, '{"subject": "pizza"}'), (2, '{"subject": "pizza"}'), (3, None), (4, "")], "k long, d string")
    found = requirements.constraint_rules(df, "k", "d")
    assert {r.k: (r.asked, len(r.rules)) for r in found.collect()} == {1: (True, 1), 2: (True, 1), 3: (False, 0), 4: (False, 0)}
    assert "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_gathered_rows_grow_in_number(spark):
    from larder.sources import gathered

    rows, cores = spark.range(2000).select((F.col("id") % 400).alias("k")), spark.sparkContext.defaultParallelism
    assert gathered(rows, "k", 2000).rdd.getNumPartitions() == cores
    many = gathered(rows, "k", 2000, most=100)
    assert many.rdd.getNumPartitions() == 20
    places = many.withColumn("task", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("task").alias("tasks"), F.count(F.lit(1)).alias("n"))
    assert [tuple(r) for r in places.groupBy("tasks", "n").count().collect()] == [(1, 5, 400)]


@pytest.mark.parametrize("name", ["agg_recipe_macros", "agg_source_mix"])
def test_lines_meet_their_recipe_before_they_are_summed(spark, sf_dir, name):
    from larder.plans.registry import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning(l_orderkey")
    # in the task of the join, sums would hold an entry for nearly each line, and sorting would hold the lines
    assert "partial_" in above and not any(x in below for x in ("partial_sum", "partial_count", "Sort [l_partkey"))


def test_few_facts_do_not_bring_parts_together_by_name(spark, sf_dir):
    from larder.plans.units import foods

    assert "SortMergeJoin [_name" not in foods(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
