"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import blank_to_null, share


def multivalue_counts(df: DataFrame, column: str, separators: str, least: int, top: int, base: int | Column | None = None) -> DataFrame:
    """Values of a delimited column with their counts: at least `least`, the `top` most frequent, with their share of all rows."""
    values = df.select(F.explode(F.split(column, separators)).alias("v")).select(blank_to_null(F.lower("v")).alias("value")).filter("value is not null")
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "value").limit(top)
    total = df.agg(F.count(F.lit(1)).alias("base"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(100 * share(F.col("n"), F.col("base")), 4).alias("pct"))


def scan_funnel(df: DataFrame, matching: Column, empties: dict[str, Column]) -> DataFrame:
    """One row: all rows, matching rows, and matching rows with an empty field, with shares, in one pass."""
    n = F.count(F.lit(1))
    m = F.count_if(matching)
    out = [n.alias("n_rows"), m.alias("n_matching"), F.round(100 * share(m, n), 4).alias("matching_pct")]
    for name, empty in empties.items():
        e = F.count_if(matching & empty)
        out += [e.alias(f"empty_{name}"), F.round(100 * share(e, m), 4).alias(f"empty_{name}_pct")]
    return df.agg(*out)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their rate of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(share(F.col("n"), F.col("total")), 6).alias("rate"))


def stage_conversion(df: DataFrame, batch: Column, candidate: Column, passed: Column) -> DataFrame:
    """Per batch and running: rows, candidates, passes and their rates. Windows run over the batch table only."""
    per = df.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count_if(candidate).alias("candidates"), F.count_if(candidate & passed).alias("passed"))
    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({f"cum_{c}": F.sum(c).over(w) for c in ("n", "candidates", "passed")})
    return per.withColumns({"pass_rate": F.round(share(F.col("passed"), F.col("candidates")), 6), "cum_pass_rate": F.round(share(F.col("cum_passed"), F.col("cum_candidates")), 6)})


def merge_lines(lines: DataFrame, keys: list[str], quantity: str, unit: str) -> DataFrame:
    """Quantities summed where all linked lines have one unit, else blank; whole numbers shown as integers, others as they are.

    Lines without a quantity or a unit count as lines, but neither sum nor forbid a sum. A quantity that is no number blanks the
    result. Quantities may be numbers or texts."""
    text = F.trim(F.col(quantity).cast("string"))
    linked = F.coalesce((text != "") & (F.trim(F.col(unit)) != ""), F.lit(False))
    number = F.when(linked, text.try_cast("double"))
    g = lines.groupBy(*keys).agg(
        F.sum(number).alias("q"), F.count_if(linked & number.isNull()).alias("odd"), F.count_distinct(F.when(linked, F.col(unit))).alias("units"), F.min(F.when(linked, F.col(unit))).alias("u"), F.count(F.lit(1)).alias("n_lines")
    )
    shown = F.when(F.col("q") == F.floor("q"), F.col("q").cast("decimal(38,0)").cast("string")).otherwise(F.col("q").cast("string"))
    one = (F.col("units") == 1) & (F.col("odd") == 0)
    return g.select(*keys, F.when(one, shown).otherwise("").alias("quantity"), F.when(one, F.col("u")).otherwise("").alias("unit"), "n_lines")


#: Macros of a session, in the order in which a nutrient's name is tried (fixed values): a part of the name, and the total.
SESSION_MACROS = [("calorie", "calories"), ("protein", "protein"), ("fat", "fat"), ("carb", "carbs")]


def session_totals(nutrients: DataFrame, session: str, meal: str, name: str, amount: str) -> DataFrame:
    """Per session: meals, four totals and their means per meal. `nutrients` has a row per nutrient of a saved meal, or one with a null name.

    A nutrient goes to the first macro whose word its name contains; its value is what is left of the amount's digits and dots, 0
    where that is no number. Meals are counted by partial sums of (session, meal), so no session meets in one task."""
    value = F.coalesce(F.regexp_replace(F.col(amount).cast("string"), r"[^0-9.]", "").try_cast("double"), F.lit(0.0))
    macro = F.lit(None).cast("string")
    for word, total in reversed(SESSION_MACROS):
        macro = F.when(F.lower(F.col(name)).contains(word), total).otherwise(macro)
    rows = nutrients.select(F.col(session).alias("s"), F.col(meal).alias("m"), macro.alias("macro"), value.alias("v"))
    sums = [F.coalesce(F.sum(F.when(F.col("macro") == total, F.col("v"))), F.lit(0.0)).alias(total) for _, total in SESSION_MACROS]
    per_session = rows.groupBy("s", "m").agg(*sums).groupBy("s").agg(F.count("m").alias("meals"), *[F.sum(total).alias(total) for _, total in SESSION_MACROS])
    return per_session.select(F.col("s").alias(session), "meals", *[F.round(total, 4).alias(total) for _, total in SESSION_MACROS], *[F.round(F.try_divide(F.col(total), F.col("meals")), 4).alias(f"{total}_per_meal") for _, total in SESSION_MACROS])


def parse_quality(df: DataFrame, keys: list[str], ok: Column, failed: Column, timeout: Column) -> DataFrame:
    """Attempts, results and the rate of successes among successes and failures, rounded to two digits; the grade is by the exact rate."""
    n = F.count(F.lit(1))
    g = df.groupBy(*keys).agg(n.alias("attempted"), F.count_if(ok).alias("ok"), F.count_if(failed).alias("failed"), F.count_if(timeout).alias("timeouts"))
    rate = F.try_divide(F.col("ok").cast("double"), F.col("ok") + F.col("failed"))
    label = F.when(rate.isNull(), "none").when(rate >= 0.8, "excellent").when(rate >= 0.6, "good").when(rate >= 0.4, "acceptable").otherwise("poor")
    return g.withColumn("success_rate", F.round(F.coalesce(rate, F.lit(0.0)), 2)).withColumn("quality", label)


def error_class(message: Column) -> Column:
    """crawl_blocked, timeout, no_data or other, by what the message says."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.rlike("403|forbidden"), "crawl_blocked").when(m.contains("timeout"), "timeout").when(m.contains("no recipe data found"), "no_data").otherwise("other")


def queue_status(jobs: DataFrame, user: str, status: str, slots: int = 22) -> DataFrame:
    """One row per user with jobs: depth of the queue and whether one is worked on; beside it the slots of the whole system, which all
    users share, and the number of users."""
    per_user = jobs.groupBy(user).agg(F.count_if(F.col(status) == "queued").alias("depth"), F.count_if(F.col(status) == "processing").alias("_running"))
    total = per_user.agg(F.coalesce(F.sum("_running"), F.lit(0)).alias("active_slots"), F.count(F.lit(1)).alias("active_users"))  # one row
    rows = per_user.crossJoin(F.broadcast(total))
    return rows.select(user, "depth", (F.col("_running") > 0).alias("running"), "active_slots", F.greatest(F.lit(0), slots - F.col("active_slots")).alias("free_slots"), "active_users")


def site_performance(scores: DataFrame, site: str, means: list[str]) -> DataFrame:
    """Per site: rows and the mean of each score, with one digit."""
    return scores.groupBy(site).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 1).alias(c) for c in means])


#: Seconds that an answer may take for 1.0, 0.8 and 0.5, and how much longer or shorter by difficulty (fixed values).
LATENCY_BANDS = [(15.0, 1.0), (30.0, 0.8), (45.0, 0.5)]
LATENCY_FACTORS = {"easy": 0.7, "hard": 1.5}
#: What an error that may happen says, wordings of answers with a fallback, and of confident and doubtful ones (fixed values).
USUAL_ERRORS = ["403", "forbidden", "timeout", "rate limit"]
MIXED_WORDING = ["close alternative", "might work", "come close", "plus some"]
CLOSEST_WORDING = ["close", "best matches available", "come close to"]
CONFIDENT_WORDING = ["found some", "meet your requirements", "found recipes"]
DOUBTFUL_WORDING = ["close", "alternative", "might"]


def latency_score(seconds: Column, difficulty: Column) -> Column:
    """1, 0.8, 0.5 or 0.2 by the bands, which an easy case narrows and a hard one widens; 0 if nothing was measured."""
    factor = F.coalesce(*[F.when(difficulty == d, f) for d, f in LATENCY_FACTORS.items()], F.lit(1.0))
    out = F.when(seconds.isNull(), 0.0)
    for most, score in LATENCY_BANDS:
        out = out.when(seconds <= most * factor, score)
    return out.otherwise(0.2)


def success_score(failed: Column, found: Column, expected: Column) -> Column:
    """0 on an error or without results, else the share of the expected number (5 if none is stated), 1 at most."""
    want = F.coalesce(expected, F.lit(5))
    return F.when(F.coalesce(failed, F.lit(False)) | (F.coalesce(found, F.lit(0)) == 0), 0.0).when(found >= want, 1.0).otherwise(found.cast("double") / want)


def usual_error(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return m.rlike("|".join(USUAL_ERRORS))


def error_score(expected: Column, errors: Column, unusual: Column, classified: Column) -> Column:
    """Where errors are expected: 0.5 without any, 1 if they are classified, else 0.3. Else: 1 without any, 0.1 with an unusual one, 0.8
    with usual ones only. `errors` and `unusual` are numbers."""
    return F.when(expected, F.when(errors == 0, 0.5).when(classified, 1.0).otherwise(0.3)).otherwise(F.when(errors == 0, 1.0).when(unusual > 0, 0.1).otherwise(0.8))


def save_score(request: Column, searched: Column) -> Column:
    """A command to save must not search (1, else 0); any other request should (1, else 0.2)."""
    return F.when(F.lower(request).rlike(SAVE), F.when(searched, 0.0).otherwise(1.0)).otherwise(F.when(searched, 1.0).otherwise(0.2))


def fallback_score(answer: Column, fallback: Column, exact: Column) -> Column:
    """Whether an answer words what it is: beside exact matches some alternatives (1 or 0.3), only the closest ones (1 or 0.2), or
    exact ones only, confident and without doubt (1 or 0.6)."""
    says = lambda words: F.lower(answer).rlike("|".join(words))
    near = F.when(exact > 0, F.when(says(MIXED_WORDING), 1.0).otherwise(0.3)).otherwise(F.when(says(CLOSEST_WORDING), 1.0).otherwise(0.2))
    return F.when(fallback, near).otherwise(F.when(says(CONFIDENT_WORDING) & ~says(DOUBTFUL_WORDING), 1.0).otherwise(0.6))


def domain_diversity(per_domain: DataFrame, keys: list[str]) -> DataFrame:
    """Share of domains with at most two items, plus 0.1 for each domain from the third on up to 0.2, 1 at most; per_domain has n."""
    good, n = F.count_if(F.col("n") <= 2), F.count(F.lit(1))
    return per_domain.groupBy(*keys).agg(F.least(F.lit(1.0), F.round(good / n + F.when(n >= 3, F.least(F.lit(0.2), 0.1 * (n - 2))).otherwise(0.0), 6)).alias("diversity"))


#: What a short answer must not hold (fixed values): names and lists of recipes, URLs, ingredients, instructions.
FORBIDDEN = [r"""(?i)["']\w+.*["']\s*recipe""", r"(?i)\d+\.\s+\w+.*(?:recipe|with|ingredients)", r"https?://|www\.", r"(?i)ingredients?:\s*[\[\(]|cups?\s+of|tablespoons?", r"(?i)step\s+\d+|preheat|bake\s+for|cook\s+until"]
SAVE = r"save\s+(?:meal|recipe)\s*#?\d+|save\s+the\s+\w+\s+one"


def clean_score(text: Column) -> Column:
    """1 less 0.3 for each kind of forbidden content, 0 at least."""
    kinds = sum((F.when(text.rlike(p), 1).otherwise(0) for p in FORBIDDEN), F.lit(0))
    return F.greatest(F.lit(0.0), 1.0 - 0.3 * kinds)


def brevity_score(text: Column) -> Column:
    """1 for up to two sentences, 0.8 for three, 0.4 up to five, else 0.1."""
    n = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != ""))
    return F.when(n <= 2, 1.0).when(n == 3, 0.8).when(n <= 5, 0.4).otherwise(0.1)


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The latest row of each key, by a partial aggregation."""
    return df.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("_m")).select(key, *[f"_m.{c}" for c in [*order, *columns]])
