"""Scores and tiers as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import filled, first_hit
from larder.operators.lookups import small
from larder.sources.scratch import staged


def completeness(groups: list[tuple[float, list[str]]]) -> Column:
    """Weighted share of filled columns, rounded to 4 digits."""
    parts = [F.lit(w) * reduce(add, [F.when(filled(c), 1).otherwise(0) for c in cols]) / len(cols) for w, cols in groups]
    return F.round(reduce(add, parts), 4)


def quality_tier(score: Column, in_market: Column, image_url: Column) -> Column:
    """Exactly one tier. Outside the market everything is rejected. tier1 needs a front image of 400 or 600 pixels, tier2 no image
    marked invalid, tier3 an image that is there and not marked invalid."""
    image = F.lower(F.trim(F.coalesce(image_url, F.lit(""))))
    valid = ~image.contains("invalid")
    sharp = image.contains("front") & (image.contains(".400.") | image.contains(".600."))
    return first_hit([(~F.coalesce(in_market, F.lit(False)), "rejected"), ((score >= 0.8) & valid & sharp, "tier1"), ((score >= 0.6) & valid, "tier2"), ((score >= 0.4) & valid & (image != ""), "tier3")], "rejected")


def required_gate(title: Column, image: Column, ingredients: Column, instructions: Column) -> Column:
    """Title, an http image, an ingredient and instructions of more than 10 characters are all there."""
    return reduce(and_, [F.coalesce(c, F.lit(False)) for c in (filled(title), image.rlike("^https?://"), filled(ingredients), F.length(instructions) > 10)])


def query_words(text: Column) -> Column:
    """Distinct words of a query, in lower case, as they stand between blanks."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def title_words(text: Column) -> Column:
    """Distinct runs of letters, digits and underscores, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


#: Fields of an item and their weights.
FIELDS = ["title", "ingredients", "text", "category"]
GRAM = 8


def word_grams(text: Column) -> Column:
    """Distinct runs of one to GRAM characters in the words of a text, found in one pass."""
    longest = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?=(\S{{1,{GRAM}}}))"), F.lit(1)))
    begun = lambda n: lambda x: F.substring(x, 1, n)
    shorter = lambda g: [F.transform(g, begun(n)) for n in range(1, GRAM)]
    # as the only element of an array, the runs are found once and not once for each use
    return F.get(F.transform(F.array(longest), lambda g: F.array_distinct(F.concat(g, *shorter(g)))), F.lit(0))


#: Pairs of an item and a query that one task adds up, about.
PAIRS_PER_TASK = 2_000_000
#: In place of a word, which has no blank: what meets every query, and what meets the queries without words.
EVERY, WORDLESS = " ", "  "


def query_relevance(items: DataFrame, queries: DataFrame, item: str, title: str, ingredients: str, text: str, category: str, need: float | Column, keep: list[str] | None = None) -> DataFrame:
    """(item, query_id, relevance) for every pair whose relevance is at least `need`, a number or a column of the items, with the
    items' `keep` columns. Items and queries have a row each.

    Relevance is 0.4, 0.3, 0.2 and 0.1 times the share of the query's words that are among the words of the title, and that the
    ingredients, the text and the category contain; 0.5 for a query without words. Queries have query_id and words; `title` is an array of words.

    An inverted index finds the pairs: an item's texts meet the words of all queries by the first letters, GRAM at most, and are searched for
    those that begin so; a pair's counts are added up over the postings of the words found, so pairs without a common word never come up.
    An item meets every query only where it needs nothing, since each of those pairs is in the result. Items are dealt by their key once,
    in tasks of PAIRS_PER_TASK pairs at most, about; all that follows stays in its task.
    """
    spark, texts = items.sparkSession, [ingredients, text, category]
    need = (F.lit(need) if isinstance(need, float) else need).cast("double")
    kept = {f"_k{k}": F.col(c) for k, c in enumerate(keep or [])}
    of_item = ["_need", *kept]

    wanted = queries.select("query_id", F.size("words").alias("n"), F.explode(F.array_distinct("words")).alias("word"))
    every = queries.select("query_id", F.size("words").alias("n"))
    postings = staged(wanted.unionByName(every.withColumn("word", F.lit(EVERY))).unionByName(every.filter("n = 0").withColumn("word", F.lit(WORDLESS))), "postings")
    # a word is looked up whole among a title's words, and by its first letters in the other texts; marks stand for themselves
    words = wanted.select("word").distinct()
    marks = spark.createDataFrame([(EVERY,), (WORDLESS,)], "word string")
    index = [words.select(F.lit(1).alias("kind"), F.col("word").alias("gram"), "word"), words.filter("word <> ''").select(F.lit(2).alias("kind"), F.substring("word", 1, GRAM).alias("gram"), "word"), marks.select(F.lit(3).alias("kind"), F.col("word").alias("gram"), "word")]
    index = staged(index[0].unionByName(index[1]).unionByName(index[2]), "words")

    pairs = items.count() * queries.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS_PER_TASK))
    dealt = items.select(item, need.alias("_need"), *[c.alias(k) for k, c in kept.items()], F.col(title).alias("_f0"), *[F.col(c).alias(f"_f{k}") for k, c in enumerate(texts, 1)]).repartition(tasks, F.col(item))
    marked = lambda kind, field, a: F.transform(a, lambda g: F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), g.alias("gram")))
    sought = [marked(1, 0, F.coalesce("_f0", F.array().cast("array<string>"))), *[marked(2, k, word_grams(F.col(f"_f{k}"))) for k in (1, 2, 3)]]
    sought.append(marked(3, -1, F.when(F.col("_need") <= 0, F.array(F.lit(EVERY), F.lit(WORDLESS))).otherwise(F.array(F.lit(WORDLESS)))))
    met = dealt.select(item, *of_item, "_f1", "_f2", "_f3", F.inline(F.concat(*sought))).join(small(index, 400_000), ["kind", "gram"])
    # only a longer word than that isn't found yet
    longer = (F.col("kind") == 2) & (F.length("word") > GRAM)
    there = F.coalesce(*[F.when(longer & (F.col("field") == k), F.contains(F.col(f"_f{k}"), F.col("word"))) for k in (1, 2, 3)], F.lit(True))
    first = lambda *names: [F.first(c).alias(c) for c in names]
    held = met.filter(there).groupBy(item, "word").agg(F.bit_or(F.expr("case field when 0 then 1 when 1 then 2 when 2 then 4 when 3 then 8 else 0 end")).alias("_in"), *first(*of_item))
    has = [F.sum(F.shiftrightunsigned("_in", k).bitwiseAND(1)).alias(f"_n{k}") for k in range(len(FIELDS))]
    met = held.join(small(postings, 200_000), "word").groupBy(item, "query_id").agg(*has, *first("n", *of_item))
    share = [F.col(f"_n{k}") / F.col("n") for k in range(len(FIELDS))]
    scored = 0.4 * share[0] + 0.3 * share[1] + 0.2 * share[2] + 0.1 * share[3]
    relevance = F.when(F.col("n") == 0, 0.5).otherwise(F.least(F.lit(1.0), F.round(scored, 6)))
    rows = met.withColumn("relevance", relevance).filter(F.col("relevance") >= F.col("_need"))
    return rows.select(item, "query_id", "relevance", *[F.col(k).alias(c) for k, c in zip(kept, keep or [], strict=True)])


def filled_share(columns: list[Column], blank_counts: bool = False) -> Column:
    """Share of the columns that are not null (and, unless `blank_counts`, not blank)."""
    one = lambda c: F.when(c.isNotNull() if blank_counts else filled(c), 1.0).otherwise(0.0)
    return reduce(add, [one(c) for c in columns]) / len(columns)


def recipe_extras(nutrition: list[Column], other: list[Column], trusted: Column) -> Column:
    """What a recipe's total has besides relevance: 0.13 share of nutrition fields, 0.02 share of other fields, 0.15 for a trusted site."""
    return 0.13 * filled_share(nutrition, True) + 0.02 * filled_share(other) + 0.15 * F.when(trusted, 1.0).otherwise(0.0)


def recipe_total(required: Column, relevance: Column, nutrition: list[Column], other: list[Column], trusted: Column) -> Column:
    """0 without the required fields, else 0.70 relevance and the extras of `recipe_extras`, 1 at most."""
    return total_with(required, relevance, recipe_extras(nutrition, other, trusted))


def total_with(required: Column, relevance: Column, extras: Column) -> Column:
    """`recipe_total` where the extras are there already."""
    return F.when(F.coalesce(required, F.lit(False)), F.least(F.lit(1.0), F.round(0.70 * relevance + extras, 7))).otherwise(0.0)


def relevance_needed(required: Column, extras: Column, least: float) -> Column:
    """The relevance that a recipe needs for a total of `least`, a little less for rounding; null if none is enough."""
    return F.when(F.coalesce(required, F.lit(False)), F.greatest(F.lit(0.0), (least - extras) / 0.70 - 1e-6))


def site_trust(df: DataFrame, site_tiers: DataFrame, domain: str, keywords: list[str]) -> DataFrame:
    """Points 60 or 45 by the tier of the site, 30 by a keyword in the domain, else 15."""
    joined = df.join(site_tiers.select(F.col("site").alias(domain), "tier"), domain, "left")
    points = first_hit([(F.col("tier") == "trusted", 60), (F.col("tier") == "good", 45), (F.col(domain).rlike("|".join(keywords)), 30)], 15)
    return joined.withColumn("trust_points", points).drop("tier")


def image_points(n_images: Column, main: Column, scalar: Column) -> Column:
    """Up to 30. With images: 15, 20 for two, 25 from three on, 5 more for a main image that looks large, 5 less for a thumbnail. With
    a single URL only: 25 if it looks large, 10 for a thumbnail, else 15."""
    large = lambda u: F.coalesce(u.rlike("1200|1500|large|hero"), F.lit(False))
    small_ = lambda u: F.coalesce(u.rlike("thumb|150"), F.lit(False))
    several = F.when(n_images >= 3, 25).when(n_images >= 2, 20).otherwise(15) + F.when(large(main), 5).when(small_(main), -5).otherwise(0)
    single = F.when(large(scalar), 25).when(small_(scalar), 10).otherwise(15)
    return F.when(n_images > 0, F.least(F.lit(30), several)).when(filled(scalar), single).otherwise(0)


def content_points(n_ingredients: Column, n_steps: Column) -> Column:
    """15 for 5 ingredients and 3 steps, 10 for 3 and 2, else 5."""
    return F.when((n_ingredients >= 5) & (n_steps >= 3), 15).when((n_ingredients >= 3) & (n_steps >= 2), 10).otherwise(5)


def item_quality(site: Column, image: Column, content: Column) -> Column:
    return F.least(F.lit(100), site + image + content)


def item_completeness(title: Column, n_ingredients: Column, n_steps: Column, n_images: Column, image_url: Column, minutes: Column, servings: Column, nutrition: Column) -> Column:
    has = lambda c, points: F.when(c, points).otherwise(0)
    images = F.when(n_images >= 3, 15).when((n_images > 0) | filled(image_url), 10).otherwise(0)
    total = has(title, 10) + F.least(F.lit(25), 3 * n_ingredients) + F.least(F.lit(25), 4 * n_steps) + images + has(minutes, 10) + has(servings, 10) + has(nutrition, 10)
    return F.least(F.lit(100), total)


def constraint_accuracy(n_met: Column, n_constraints: Column, query: Column, text: Column) -> Column:
    """Share of the constraints that are met, in percent. Without any: 50 plus the share of the query's words that have more than
    three letters and are in the text, 100 at most."""
    words = F.filter(F.split(F.lower(query), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: (F.length(w) > 3) & F.contains(F.lower(text), w)))
    plain = F.least(F.lit(100.0), F.coalesce(F.try_divide(hits.cast("double"), F.size(words)), F.lit(0.0)) * 100 + 50)
    return F.when(n_constraints > 0, F.least(F.lit(100.0), F.try_divide(n_met.cast("double"), n_constraints) * 100)).otherwise(plain)


def speed_score(seconds: Column) -> Column:
    """100, 80 and 60 up to 12, 20 and 40 seconds, then 1.5 less per second, 10 at least."""
    return F.when(seconds <= 12, 100.0).when(seconds <= 20, 80.0).when(seconds <= 40, 60.0).otherwise(F.greatest(F.lit(10.0), 60.0 - (seconds - 40) * 1.5))


def item_overall(quality: Column, accuracy: Column, complete: Column) -> Column:
    return F.round(0.40 * quality + 0.35 * accuracy + 0.25 * complete, 1)


#: Seconds a search strategy may take; others get 60 (fixed values).
BUDGETS = {"priority_only": 30.0, "mixed": 60.0, "broad": 90.0}


def time_status(elapsed: Column, strategy: Column) -> Column:
    """exceeded, approaching_limit (more than half of the strategy's budget) or on_track."""
    budget = F.coalesce(*[F.when(strategy == s, b) for s, b in BUDGETS.items()], F.lit(60.0))
    return F.when(elapsed > budget, "exceeded").when(elapsed > budget * 0.5, "approaching_limit").otherwise("on_track")


def next_action(elapsed: Column, found: Column) -> Column:
    return first_hit([(elapsed > 60, "ask_user"), ((elapsed > 30) & (found < 10), "pivot"), (found < 5, "expand")], "continue")


# Patterns of URLs of lists, of URLs that are no recipes, and of single recipes; words of recipe links and of their
# surroundings.
LIST_URLS = ["/recipes/collection/", "/recipes/category/", "/recipes/tag/", "/collection/", "/category/", "roundup", "best-.*-recipes", "top-.*-recipes", "-recipes/?$", "guide/", "howto/"]
OTHER_URLS = ["/(?:about|contact|privacy|terms)", "/(?:category|tag|author)", "/#", "/page/", "/(?:feed|rss)", "/(?:search|shop|store)", "/wp-", "javascript:", "mailto:", "tel:", "/(?:login|register)", "/(?:newsletter|subscribe)"]
RECIPE_URLS = ["/recipe/[^/]+/?$", "/recipes/[^/]+/?$", "-recipe/?$", r"-recipe\.", r"recipe\?", r"/\d{4}/\d{2}/.+"]
FOOD_WORDS = [
    "chicken", "beef", "pork", "fish", "salmon", "tuna", "shrimp", "pasta", "noodles", "rice", "quinoa", "bread", "pizza", "salad", "soup", "stew", "curry", "stir fry", "casserole", "cake", "cookies", "pie", "muffins", "pancakes", "waffles",
    "breakfast", "lunch", "dinner", "snack", "appetizer", "dessert", "sandwich", "wrap", "burger", "tacos", "enchiladas", "smoothie", "shake", "bowl", "plate", "dish",
]
CONTEXT_WORDS = ["minutes", "hours", "serves", "calories", "protein"]


def is_recipe_url(url: Column) -> Column:
    u = F.lower(url)
    return F.coalesce(~u.rlike("|".join(LIST_URLS)) & ~u.rlike("|".join(OTHER_URLS)) & u.rlike("|".join(RECIPE_URLS)), F.lit(False))


def link_confidence(url: Column, text: Column, has_image: Column, context: Column) -> Column:
    """Points of a link to a single recipe: 2 for a recipe URL, 2 for a food word, 1 each for a text of 10 to 100 characters, an image
    beside it, and words of a recipe around it. Other URLs get 0. Links count from 3 on."""
    hit = lambda c, points: F.when(F.coalesce(c, F.lit(False)), points).otherwise(0)
    points = hit(F.lower(url).contains("recipe"), 2) + hit(F.lower(text).rlike("|".join(FOOD_WORDS)), 2) + hit(F.length(text).between(10, 100), 1) + hit(has_image, 1) + hit(F.lower(context).rlike("|".join(CONTEXT_WORDS)), 1)
    return F.when(is_recipe_url(url), points).otherwise(0)


def url_type(title: Column, url: Column) -> Column:
    """list by a title with best, top, recipes or roundup; recipe by the URL or the title; else other."""
    t, u = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return F.when(t.rlike("best|top|recipes|roundup"), "list").when(u.contains("/recipe/") | t.contains("recipe"), "recipe").otherwise("other")


#: Cuisines that a reference may name (fixed values).
CUISINES = ["scottish", "italian", "mexican", "asian", "french", "american"]


def reference_match(description: Column, title: Column, position: Column, minutes: Column) -> Column:
    """How well a shown recipe fits what a user says of it, 0 to 1.

    0.5 for a word of more than three letters that the title contains; 1 for the first, second or third (or #1 to #3) at that
    position, else 0.8 for the last from position 3 on; 0.7 for a quick one of at most 30 minutes; 0.8 for each cuisine in both."""
    said, name = F.lower(F.coalesce(description, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    named = F.exists(F.split(said, r"\s+"), lambda w: (F.length(w) > 3) & F.contains(name, w))
    at = lambda k: F.when(position == k, 1.0).otherwise(0.0)
    places = [(said.contains(word) | said.contains(f"#{k}"), at(k)) for k, word in enumerate(("first", "second", "third"), 1)]
    place = first_hit([*places, (said.contains("last"), F.when(position >= 3, 0.8).otherwise(0.0))], 0.0)
    quick = F.when(said.contains("quick") & (minutes > 0) & (minutes <= 30), 0.7).otherwise(0.0)
    styles = reduce(add, [F.when(said.contains(c) & name.contains(c), 0.8).otherwise(0.0) for c in CUISINES])
    return F.round(F.least(F.lit(1.0), F.when(named, 0.5).otherwise(0.0) + place + quick + styles), 6)


def best_reference(pairs: DataFrame, keys: list[str], item: str, score: str) -> DataFrame:
    """The item with the highest score above 0 per key, the first of equal ones."""
    return pairs.filter(F.col(score) > 0).groupBy(*keys).agg(F.max(score).alias(score), F.min_by(item, F.struct(-F.col(score), F.col(item))).alias(item))
