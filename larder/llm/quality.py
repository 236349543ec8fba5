"""Quality rules with risk-controlled thresholds.

Base rules are fixed. On top, each stratum (language) gets a cut-off per rule, chosen on labelled holdout rows so that few good
documents are rejected. The holdout is split by a digest of the text. One quarter only proposes: per rule, the strictest cut-off of
the grid that rejects at most `propose` of its good documents, and from there configurations that are up to `STEPS` grid steps
more lenient in every rule. The other three quarters test these configurations from lenient to strict, each as a whole: a
configuration passes if the exact binomial tail P(Bin(n, limit) <= rejected) is at most `delta` divided by the number of strata
tested. The first that fails ends the sequence, and the last that passed is used. A fixed sequence needs no division by the number
of configurations, and strata are corrected by Bonferroni.

What is guaranteed: with probability 1 - `delta` over the draw of the holdout, in every stratum the rules together reject
at most `max_false_rejection` of those good documents that pass the base rules. It holds if labelled documents are drawn like the
others; documents that the base rules reject are outside it. Copies are not independent draws, so a text counts once. A stratum
with too few labels (`n_min` in its test part) gets no cut-offs and loses documents to the base rules only.

All labelled rows are counted. Everything is a DataFrame expression. One narrow pass computes the metrics and writes them to a
scratch table, with the columns that go on; holdout, test and verdict read that table, so no text is measured twice or shuffled.
The cut-offs are a row per stratum of at least `n_min` labels; they are broadcast if there are at most `MAX_STRATA`, else joined.

Defined cases: null text has no words (and fails the base rule on n_words); null lang is the stratum "". A text of any length is
measured as a whole; it must fit a row. Repeated rows are judged alike; a doc_id with several texts has one label for all of them. Null
doc_ids have no label. Empty tables give empty results. Labels of one doc_id that disagree count as the worse one. Columns of the
input that share a name with an output column are replaced by the output; others pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import free_names, WS, let, staged, text_or_empty

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Cut-offs tried per rule, from lenient to strict; a document whose score is above the cut-off is rejected.
GRID = {
    "symbol_rate": (2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02),
    "dup_line_rate": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "repeat_word_rate": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "long_words": (40.0, 25.0, 18.0, 14.0, 12.0, 10.0, 9.0, 8.0, 7.0),
    "short_words": (-1.2, -1.5, -1.8, -2.0, -2.3, -2.6, -3.0, -3.3, -3.6),
}


#: Configurations tried per stratum, less one.
STEPS = 5
#: First hexadecimal digits of a text's MD5 for which it is in the part that proposes cut-offs.
PROPOSING = "0123"
MAX_STRATA = 10_000


@dataclass(frozen=True)
class RiskControl:
    """max_false_rejection: share of a stratum's good documents that all rules together may reject.
    delta: probability that any stratum exceeds it.
    propose: share of the proposing part's good documents that one rule's strictest cut-off may reject."""

    max_false_rejection: float = 0.02
    delta: float = 0.05
    propose: float = 0.002

    @property
    def n_min(self) -> int:
        """Fewer labelled good rows can't pass the test even if none is rejected and there is one stratum."""
        return math.ceil(math.log(self.delta) / math.log1p(-self.max_false_rejection))


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the metric columns, all long, plus n_lines (lines with a word)."""
    keep = [c for c in docs.columns if c not in {*METRICS, "n_lines"}]
    body = text_or_empty(text)
    words = F.array_remove(F.split(body, WS, -1), "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols")
    w, x = free_names(docs, "_w", "_l")
    shown = [F.col(f"`{c}`") for c in keep]
    return docs.select(*shown, symbols, of_words.alias(w), of_lines.alias(x)).select(*shown, "n_symbols", f"{w}.*", f"{x}.*")


def _repeat_words(words: Column) -> Column:
    """Words in windows of three whose words occur in another window too. Windows are compared by a 64-bit hash."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def positions(sorted_windows: Column) -> Column:
        # equal windows are neighbours after the sort
        twice = F.transform(
            sorted_windows,
            lambda x, k: F.when((F.get(sorted_windows, k - 1)["h"] == x["h"]) | (F.get(sorted_windows, k + 1)["h"] == x["h"]), x["i"]),
        )
        return F.array_sort(F.array_compact(twice))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    return F.when(n < 4, F.lit(0)).otherwise(covered(let(F.array_sort(windows), positions)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def scores() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_rate": F.col("n_symbols") / n,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_rate": F.col("n_repeat_words") / n,
        "long_words": F.col("word_chars") / n,
        "short_words": -F.col("word_chars") / n,
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from its exact terms in log space."""
    step = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")),
        F.struct((n * math.log1p(-p)).cast("double").alias("term"), F.lit(0.0).alias("total")),
        lambda a, i: F.struct((a["term"] + F.log((n - i) / (i + 1)) + math.log(p / (1 - p))).alias("term"), (a["total"] + F.exp(a["term"])).alias("total")),
        lambda a: a["total"],
    )
    return F.when(k >= n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), step))


def holdout(labels: DataFrame) -> DataFrame:
    """doc_id, once each, of all labelled rows that are good: quality 1 and not toxic."""
    per_doc = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return per_doc.filter((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


def measured(docs: DataFrame, stratum: str = "lang", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A scratch table of `_d` (a struct of the `carry` columns, default: all), `_stratum`, `_text_id` (MD5 of the text) and the metrics."""
    own = {*METRICS, "n_lines", "base_failed", "failed_rule", "kept"}
    kept = [c for c in (docs.columns if carry is None else carry) if c not in own]
    packed = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_d")
    named = docs.select(packed, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), F.md5(text_or_empty(text)).alias("_text_id"), F.col(text).alias("_text"))
    return staged(with_metrics(named, "_text").drop("_text"), "quality-metrics")


def _strata(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_STRATA else df


def thresholds(rows: DataFrame, labels: DataFrame, control: RiskControl = RiskControl()) -> tuple[DataFrame, int]:
    """One row per stratum with cut-offs: stratum, n_test, n_rejected and a cut-off per rule (null: none), and their number.
    `rows` is a `measured` table."""
    good = rows.withColumn("doc_id", F.col("_d.doc_id")).join(holdout(labels), "doc_id").filter(~base_failed())
    # a text once per stratum
    narrow = good.groupBy(F.col("_stratum").alias("stratum"), "_text_id").agg(*[F.first(c).alias(c) for c in (*METRICS, "n_lines")])
    narrow = staged(narrow.withColumn("proposes", F.substring("_text_id", 1, 1).isin(*PROPOSING)), "quality-holdout")
    s = scores()
    a, b = narrow.filter("proposes"), narrow.filter("not proposes")
    tested = b.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= control.n_min)
    proposed = a.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_a"), *[F.count_if(s[r] > c).alias(f"{r}_{k}") for r, cuts in GRID.items() for k, c in enumerate(cuts)])

    def strictest(rule: str) -> Column:
        """Place of the strictest cut-off that rejects few enough; -1 if even the first rejects too many."""
        fits = [F.when(F.col(f"{rule}_{k}") <= control.propose * F.col("n_a"), k) for k in range(len(GRID[rule]))]
        return F.coalesce(F.greatest(*fits, F.lit(-1)), F.lit(-1))

    # configuration j is STEPS - j grid steps more lenient than the strictest: from lenient to strict
    def configured(rule: str, j: int) -> Column:
        return F.get(F.array(*[F.lit(float(c)) for c in GRID[rule]]), F.when(F.col(f"_at_{rule}") >= STEPS - j, F.col(f"_at_{rule}") - (STEPS - j)))

    plans = tested.join(proposed, "stratum").select("stratum", "n", *[strictest(r).alias(f"_at_{r}") for r in GRID])
    plans = plans.select("stratum", "n", *[configured(r, j).alias(f"{r}_{j}") for j in range(STEPS + 1) for r in GRID])
    plans = staged(plans, "quality-plans")
    n_strata = plans.count()
    joined = b.join(_strata(plans, n_strata), "stratum")
    rejects = [F.coalesce(F.greatest(*[F.coalesce(s[r] > F.col(f"{r}_{j}"), F.lit(False)) for r in GRID]), F.lit(False)) for j in range(STEPS + 1)]
    counted = joined.groupBy("stratum").agg(F.first("n").alias("n"), *[F.count_if(x).alias(f"rejected_{j}") for j, x in enumerate(rejects)])
    p = control.max_false_rejection

    def passes(j: int) -> Column:
        k = F.col(f"rejected_{j}")
        # k above the expected n * p can't pass, so its tail isn't summed
        return F.when(k > F.col("n") * p, F.lit(False)).otherwise(binomial_tail(F.col("n"), k, p) <= control.delta / max(1, n_strata))

    tests = counted.select("stratum", "n", *[f"rejected_{j}" for j in range(STEPS + 1)], F.array(*[passes(j) for j in range(STEPS + 1)]).alias("ok"))
    # configurations before the first failure
    last = F.coalesce(F.nullif(F.array_position("ok", F.lit(False)), F.lit(0)) - 1, F.lit(STEPS + 1)) - 1
    chosen = tests.withColumn("_j", last.cast("int")).filter("_j >= 0")
    at = lambda names: F.get(F.array(*[F.col(x) for x in names]), F.col("_j"))
    picked = chosen.join(_strata(plans.drop("n"), n_strata), "stratum").select(
        "stratum",
        F.col("n").alias("n_test"),
        at([f"rejected_{j}" for j in range(STEPS + 1)]).alias("n_rejected"),
        *[at([f"{r}_{j}" for j in range(STEPS + 1)]).alias(f"cut_{r}") for r in GRID],
    )
    return staged(picked, "quality-cutoffs"), n_strata


def apply_rules(rows: DataFrame, cutoffs: DataFrame, n_strata: int = 0) -> DataFrame:
    """A `measured` table with base_failed, failed_rule (first failing rule, null if none) and kept."""
    cuts = cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(f"cut_{r}").alias(f"_cut_{r}") for r in GRID])
    joined = rows.join(_strata(cuts, n_strata), "_stratum", "left")
    failed = F.when(base_failed(), F.lit("base"))
    for rule, score in scores().items():
        failed = failed.when(score > F.col(f"_cut_{rule}"), F.lit(rule))
    return joined.select("_d.*", *METRICS, "n_lines", base_failed().alias("base_failed"), failed.alias("failed_rule")).withColumn("kept", F.col("failed_rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, control: RiskControl = RiskControl(), stratum: str = "lang", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The `carry` columns of `docs` (default: all; doc_id must be among them) with metrics, base_failed, failed_rule and kept."""
    rows = measured(docs, stratum, text, carry)
    return apply_rules(rows, *thresholds(rows, labels, control))
