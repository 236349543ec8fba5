"""Row filters and projections."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import any_term, blank_to_null, col, domain, filled
from larder.operators.texts import canonical_unit, quantity_text


def required_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every column is filled."""
    return df.filter(reduce(and_, [filled(c) for c in columns]))


def numeric_range(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose columns read as numbers within their bounds."""
    return df.filter(reduce(and_, [col(c).try_cast("double").between(lo, hi) for c, (lo, hi) in bounds.items()]))


def contains_any(df: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """Rows where any of the columns contains a term of its dictionary."""
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(any_term(c, t), F.lit(False)) for c, t in terms.items()]))


def multivalue_contains(df: DataFrame, column: str, terms: list[str], separators: str = r"[,|; ]") -> DataFrame:
    """Rows where an element of the delimited list contains a term."""
    return df.filter(F.exists(F.split(F.lower(column), separators), lambda x: any_term(F.trim(x), terms)))


def without_placeholders(df: DataFrame, url: str, words: list[str]) -> DataFrame:
    """Rows whose URL is filled and holds no placeholder word."""
    return df.filter(filled(url) & ~any_term(url, words))


def unblocked(df: DataFrame, url: str, blocked: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Rows whose URL isn't in `exclude` (a table of URLs), and whose domain is there and is neither a blocked site nor below one.

    A domain is below a site if one of its suffixes at a dot is that site: an equality on exploded suffixes, so the
    joins are hash joins whatever the size of the block list.
    """
    keyed = df.withColumn("_domain", domain(url)).filter(F.col("_domain") != "")
    parts = F.split("_domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.array_join(F.slice(F.col("_parts"), i, F.size("_parts")), "."))
    names = keyed.select("_domain").distinct().withColumn("_parts", parts).select("_domain", F.explode(suffixes).alias("_site"))
    bad = names.join(blocked.select(F.lower("site").alias("_site")), "_site", "left_semi").select("_domain").distinct()
    out = keyed.join(bad, "_domain", "left_anti")
    if exclude is not None:
        out = out.join(exclude.select(F.col("url").alias(url)), url, "left_anti")
    return out.select(*df.columns, F.col("_domain").alias("domain"))


def with_image(df: DataFrame, images: str, scalar: str) -> DataFrame:
    return df.filter((F.coalesce(F.size(images), F.lit(0)) > 0) | F.coalesce(filled(scalar), F.lit(False)))


def by_id(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a wanted id, and the wanted ids that have none."""
    return df.join(ids, key, "left_semi"), ids.join(df.select(key), key, "left_anti")


def coalesce_first_valid(columns: list[str], invalid: list[str]) -> Column:
    """The first column, trimmed, that is filled and isn't one of the invalid words."""
    def value(c: str) -> Column:
        t = blank_to_null(c)
        return F.when(~F.lower(t).isin([w.lower() for w in invalid]), t)

    return F.coalesce(*[value(c) for c in columns])


def image_array(images: str | Column, source: str = "page") -> Column:
    """Array of image URLs -> array of {url, type, alt, source}; the first is main, the rest gallery."""
    return F.transform(
        F.filter(col(images), lambda x: filled(x)),
        lambda x, i: F.struct(x.alias("url"), F.when(i == 0, "main").otherwise("gallery").alias("type"), F.lit("").alias("alt"), F.lit(source).alias("source")),
    )


def main_image(images: Column, scalar: Column) -> Column:
    return F.coalesce(F.get(F.filter(images, lambda x: x["type"] == "main"), F.lit(0))["url"], scalar)


def product_record(df: DataFrame, texts: dict[str, tuple[str, int]], numbers: dict[str, str], integers: dict[str, str], flags: dict[str, Column]) -> DataFrame:
    """Target schema in one projection: texts cut to a length with blank as null, numbers and integers cast, flags."""
    return df.select(
        *[F.substring(blank_to_null(c), 1, n).alias(out) for out, (c, n) in texts.items()],
        *[F.col(c).try_cast("double").alias(out) for out, c in numbers.items()],
        *[F.col(c).try_cast("int").alias(out) for out, c in integers.items()],
        *[F.coalesce(c, F.lit(False)).alias(out) for out, c in flags.items()],
    )


def _normalised(ingredients: Column) -> Column:
    """An array of ingredient structs with quantities as decimal text and canonical units; null is an empty array."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    each = lambda x: x.withField("name", F.coalesce(x["name"], F.lit(""))).withField("quantity", quantity_text(x["quantity"])).withField("unit", canonical_unit(blank(x["unit"])))
    return F.coalesce(F.transform(ingredients, each), F.array())


#: Fields of a recipe's nutrition; each is text, empty where it is missing.
NUTRITION_FIELDS = ["calories", "fat", "carbs", "protein"]


def _shared(title: Column, parser_method: Column, source_url: Column, nutrition: Column | None, image: Column | None, meal_occasion: Column | None, total_time: Column | None) -> dict[str, Column]:
    """The fields that both kinds of record have, with their defaults."""
    text = lambda c, default="": F.lit(default) if c is None else F.coalesce(c, F.lit(default))
    facts = F.struct(*[text(None if nutrition is None else nutrition[c]).alias(c) for c in NUTRITION_FIELDS])
    return {"title": text(title), "parser_method": text(parser_method), "meal_occasion": text(meal_occasion, "Other"), "total_time": text(total_time), "nutrition": facts, "image": text(image), "source_url": text(source_url)}


def standard_record(
    title: Column, parser_method: Column, ingredients: Column, directions: Column, source_url: Column, nutrition: Column | None = None, image: Column | None = None, meal_occasion: Column | None = None, total_time: Column | None = None
) -> Column:
    """A recipe as one struct. `ingredients` are structs (name, quantity, unit), which get decimal quantities and canonical units,
    `directions` texts, `nutrition` a struct of NUTRITION_FIELDS. A missing occasion is "Other", other missing texts are empty."""
    one = _shared(title, parser_method, source_url, nutrition, image, meal_occasion, total_time)
    one |= {"ingredients": _normalised(ingredients), "directions": F.coalesce(directions, F.array().cast("array<string>"))}
    order = ["title", "parser_method", "meal_occasion", "total_time", "ingredients", "directions", "nutrition", "image", "source_url"]
    return F.struct(*[one[c].alias(c) for c in order])


def enhanced_record(
    title: Column,
    parser_method: Column,
    ingredients: Column,
    steps: Column,
    step_ingredients: Column,
    source_url: Column,
    meta_ingredients: Column | None = None,
    servings: Column | None = None,
    nutrition: Column | None = None,
    image: Column | None = None,
    meal_occasion: Column | None = None,
    total_time: Column | None = None,
) -> Column:
    """A recipe whose ingredients have an `id` and whose steps (step_number, text, type, meta_step_section) name theirs.

    `step_ingredients` maps a step's number to ids; a step that it lacks has none. `meta_ingredients` are normalised like the
    ingredients, and null (so that JSON leaves them out) where there are none. Missing servings are 0.
    """
    one = _shared(title, parser_method, source_url, nutrition, image, meal_occasion, total_time)
    ids = lambda step: F.coalesce(F.try_element_at(step_ingredients, step["step_number"]), F.array().cast("array<string>"))
    one |= {
        "servings": F.coalesce(servings, F.lit(0)) if servings is not None else F.lit(0),
        "ingredients": _normalised(ingredients),
        "directions": F.transform(steps, lambda x: F.struct(x["step_number"].alias("step_number"), x["text"].alias("text"), x["type"].alias("type"), x["meta_step_section"].alias("meta_step_section"), ids(x).alias("ingredient_ids"))),
    }
    order = ["title", "parser_method", "meal_occasion", "servings", "total_time", "ingredients", "directions", "nutrition", "image", "source_url"]
    if meta_ingredients is not None:
        one["meta_ingredients"] = F.when(F.size(meta_ingredients) > 0, _normalised(meta_ingredients))
        order.append("meta_ingredients")
    return F.struct(*[one[c].alias(c) for c in order])


def minimal_view(lines: DataFrame, key: str, order: list[str], item: str, exact: Column, n: int = 8) -> DataFrame:
    """key, ingredients (the first n items), exact_count and closest_count (lines that are exact or not, of all lines).

    The first n lines are a rank limit before the shuffle and the counts are partial aggregates, so no key's lines are collected whole.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order, item))
    first = lines.select(key, item, place.alias("_k")).filter(F.col("_k") <= n)
    shown = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_k", item))).alias("_first"))
    counts = lines.groupBy(key).agg(F.count_if(exact).alias("exact_count"), F.count_if(~F.coalesce(exact, F.lit(False))).alias("closest_count"))
    return counts.join(shown, key).select(key, F.transform("_first", lambda x: x[item]).alias("ingredients"), "exact_count", "closest_count")


def cart_eligible(quantity: Column, unit: Column, name: Column, disqualified: Column, optional: Column) -> Column:
    """Whether a line can go to a cart: store quantity, store unit and ingredient are there, and it is neither disqualified nor optional.
    A number of 0 and an empty text count as missing."""
    there = lambda c: F.coalesce(~c.cast("string").isin("", "0", "0.0"), F.lit(False))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return there(quantity) & there(unit) & there(name) & no(disqualified) & no(optional)
