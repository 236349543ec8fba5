"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import escape

#: A dictionary of more rows, or of more bytes of text, is joined by the planner's choice, not by a broadcast hint.
BROADCAST_ROWS, BROADCAST_BYTES = 10_000, 8 << 20


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if it has at most `limit` rows and `most` bytes, both measured on those rows, else unchanged.

    This reads up to limit + 1 rows of a dictionary; with rows that are literals in the plan it costs a fraction of a second."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    n, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and size <= most else df


def alias_lookup(aliases: DataFrame, ingredients: DataFrame, status: str = "active") -> DataFrame:
    """Active aliases, in lower case, with their ingredient."""
    return aliases.filter(F.col("status") == status).withColumn("alias_text", F.lower("alias_text")).join(ingredients, "ingredient_id")


def with_default(df: DataFrame, dictionary: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """`df` with the dictionary's value for `key`; unknown keys get the value of the key `default`, or null if there is none."""
    fallback = dictionary.filter(F.col(key) == default).agg(F.first(value, ignorenulls=True).alias("_default"))  # one row, always
    return df.join(small(dictionary.select(key, value)), key, "left").crossJoin(F.broadcast(fallback)).withColumn(value, F.coalesce(value, "_default")).drop("_default")


def first_match(df: DataFrame, dictionary: DataFrame, name: str, value: str = "value", whole_word: bool = False, longest: bool = False) -> DataFrame:
    """`df` with the value of the first dictionary key (by ordinal, or the longest) that its name contains, null if none.

    Only distinct names meet the dictionary, so the nested loop is names x keys; names join back by equality.
    """
    lowered = F.lower(F.col(name))
    names = df.select(lowered.alias("_name")).distinct()
    keys = dictionary.select(F.col("ordinal").alias("_o"), F.lower("key").alias("_key"), F.col(value).alias("_value"))
    hit = F.rlike("_name", F.concat(F.lit(r"\b"), F.regexp_replace("_key", r"([\\.\[\]{}()*+?^$|-])", r"\\$1"), F.lit(r"\b"))) if whole_word else F.contains("_name", "_key")
    order = F.struct(-F.length("_key"), F.col("_o")) if longest else F.col("_o")
    best = names.join(small(keys), hit).groupBy("_name").agg(F.min_by("_value", order).alias(value))
    return df.withColumn("_name", lowered).join(best, "_name", "left").drop("_name")


def nutrition_values(items: DataFrame, reference: DataFrame, estimates: DataFrame, key: str, values: list[str], defaults: dict[str, float]) -> DataFrame:
    """`items` with values of the reference, else of the estimates, else defaults, and their source."""
    ref = reference.select(key, *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(True).alias("_r"))
    est = estimates.select(key, *[F.col(v).alias(f"_e_{v}") for v in values], F.lit(True).alias("_e"))
    joined = items.join(ref, key, "left").join(est, key, "left")
    picked = [F.when(F.col("_r"), F.col(f"_r_{v}")).when(F.col("_e"), F.col(f"_e_{v}")).otherwise(defaults[v]).alias(v) for v in values]
    return joined.select(*items.columns, *picked, F.when(F.col("_r"), "reference").when(F.col("_e"), "estimate").otherwise("default").alias("source"))


def nutrition_tiered(lines: DataFrame, reference: DataFrame, estimates: DataFrame, key: str, values: list[str], defaults: dict[str, float]) -> DataFrame:
    """The same for recipe lines: the reference and the estimates meet first, so the lines meet one join."""
    known = reference.select(key).unionByName(estimates.select(key)).distinct()
    joined = lines.join(nutrition_values(known, reference, estimates, key, values, defaults), key, "left")
    return joined.select(*lines.columns, *[F.when(F.col("source").isNull(), F.lit(defaults[v])).otherwise(F.col(v)).alias(v) for v in values], F.coalesce("source", F.lit("default")).alias("source"))


# Better terms for common names, and words of preparation in the order in which they are looked for.
SEARCH_NAMES = {
    "eggs": "egg whole raw", "egg": "egg whole raw", "salt": "salt table", "butter": "butter salted", "salted butter": "butter salted", "unsalted butter": "butter without salt", "brown sugar": "sugars brown", "white sugar": "sugars granulated", "sugar": "sugars granulated",
    "all-purpose flour": "wheat flour white all-purpose", "flour": "wheat flour white all-purpose", "oats": "oats whole grain rolled", "old-fashioned oats": "oats whole grain rolled old fashioned",
}
PREPARATIONS = ["cooked", "boiled", "steamed", "baked", "roasted", "grilled", "fried", "sauteed", "sautéed", "raw"]


def search_terms(df: DataFrame, name: str, mapping: DataFrame | None = None, preparations: list[str] = PREPARATIONS) -> DataFrame:
    """search_term: the better term of the name in lower case without outer blanks (by SEARCH_NAMES or a table common, canonical), else the
    name as it is; behind it the first word of preparation that the name contains, unless the term has it."""
    key, lowered = F.lower(F.trim(F.col(name))), F.lower(F.col(name))
    if mapping is None:
        rows = df.withColumn("_better", F.element_at(F.create_map(*[F.lit(x) for pair in SEARCH_NAMES.items() for x in pair]), key))
    else:
        rows = df.withColumn("_common", key).join(small(mapping.select(F.lower(F.trim("common")).alias("_common"), F.col("canonical").alias("_better"))), "_common", "left").drop("_common")
    word = F.coalesce(*[F.when(F.contains(lowered, F.lit(p)), F.lit(p)) for p in preparations])
    term = F.coalesce("_better", F.col(name))
    return rows.withColumn("search_term", F.when(word.isNotNull() & ~F.contains(F.lower(term), word), F.concat_ws(" ", term, word)).otherwise(term)).drop("_better")


def portion_match(unit: Column, portions: Column) -> Column:
    """Weight of the first portion with weight > 0 whose unit contains the line's unit or the other way, singularised."""
    single = lambda c: F.regexp_replace(F.lower(c), "s$", "")
    return F.get(F.filter(portions, lambda p: (p["grams"] > 0) & (F.contains(single(p["unit"]), single(unit)) | F.contains(single(unit), single(p["unit"])))), F.lit(0))["grams"]


def fuzzy_similarity(target: Column, observed: Column) -> Column:
    """Best 100 * (1 - levenshtein / length) of the target over windows of its length in the observed name."""
    n, m = F.length(target), F.length(observed)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(m - n + 1, F.lit(1))), lambda i: F.levenshtein(target, F.substring(observed, i, n)))
    return F.round(100 * (1 - F.array_min(windows) / n), 2)


def grams(text: Column, n: int) -> Column:
    """Substrings of `n` characters with their occurrence, as `gram:number`, so that equal ones are told apart."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.filter(F.transform(cut, lambda g, i: F.concat_ws(":", g, F.size(F.filter(F.slice(cut, 1, i), lambda x: x == g)).cast("string"))), lambda x: F.length(x) > n)


def fuzzy_variants(names: DataFrame, targets: DataFrame, column: str, least: float = 70.0) -> DataFrame:
    """Per target: summed count and variants of the observed names with enough similarity. Names are counted first.

    Only pairs that share grams are compared. With d edits, a target of n characters keeps n - 1 - 2 d of its pairs of
    characters, or n - d of its characters where that is no bound; of the G grams one of the G - bound + 1 rarest is then shared, and
    targets and names meet by equality on those. `least` must be above 0: unlike names share nothing.
    """
    if least <= 0:
        raise ValueError("a similarity above 0 is needed")
    counted = names.groupBy(F.lower(column).alias("observed")).agg(F.count(F.lit(1)).alias("n")).filter("observed <> ''")
    n = F.length("lowered")
    edits = F.floor(n * (1 - (least - 0.005) / 100) + 1e-9).cast("int")  # similarity is rounded to two digits
    wanted = targets.select("target").distinct().withColumn("lowered", F.lower("target")).filter("lowered <> ''").withColumn("edits", edits)
    wanted = wanted.withColumn("pairs", n - 1 - 2 * F.col("edits") >= 1).withColumn("bound", F.when(F.col("pairs"), n - 1 - 2 * F.col("edits")).otherwise(F.greatest(n - F.col("edits"), F.lit(1))))
    cut = lambda c: F.explode(F.concat(grams(c, 1), grams(c, 2)))
    of_names = counted.select("observed", cut(F.col("observed")).alias("gram"))
    of_targets = wanted.select("target", "bound", F.explode(F.when(F.col("pairs"), grams(F.col("lowered"), 2)).otherwise(grams(F.col("lowered"), 1))).alias("gram"))
    often = of_names.join(small(of_targets.select("gram").distinct()), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    by_target = Window.partitionBy("target")
    ranked = of_targets.join(often, "gram", "left").withColumn("place", F.row_number().over(by_target.orderBy(F.coalesce("often", F.lit(0)), "gram"))).withColumn("all", F.count(F.lit(1)).over(by_target))
    rare = ranked.filter(F.col("place") <= F.col("all") - F.col("bound") + 1).select("target", "gram")
    pairs = of_names.join(small(rare), "gram").select("target", "observed").distinct().join(counted, "observed")
    alike = pairs.filter(fuzzy_similarity(F.lower("target"), F.col("observed")) >= least)
    return alike.groupBy("target").agg(F.sum("n").alias("total"), F.array_sort(F.collect_set("observed")).alias("variants"))


def expand_lists(candidates: DataFrame, links: DataFrame, max_lists: int = 6, per_list: int = 5, total: int = 60) -> DataFrame:
    """Per query: list candidates replaced by links of their pages, each list and the whole within their quotas."""
    lists = candidates.filter("kind = 'list'").withColumn("_l", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("_l") <= max_lists)
    found = lists.join(links, "page_id").withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "page_id").orderBy("link_pos"))).filter(F.col("_k") <= per_list)
    rows = found.select("query_id", "pos", "link_pos", F.col("href").alias("url"), F.col("page_id").alias("source_page"))
    rest = candidates.filter("kind <> 'list'").select("query_id", "pos", F.lit(0).alias("link_pos"), "url", F.lit(None).cast("long").alias("source_page"))
    both = rest.unionByName(rows).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "link_pos")))
    return both.filter(F.col("position") <= total)
