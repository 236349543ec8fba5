"""Ranking, quotas, cut-offs, de-duplication and ordered unions. Every window is partitioned by a query or session key."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.lookups import small

LAST = 1 << 30


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column], filled: str | None = None) -> DataFrame:
    """The earliest row of each key; rows with a blank `filled` column are dropped.

    A partial aggregation of whole rows, so a key with many rows is reduced before the shuffle.
    """
    rows = df if filled is None else df.filter(F.trim(filled) != "")
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    best = rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(named)]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def priority_rank(df: DataFrame, priority: DataFrame, query_id: str, domain: str, position: str, top: int | None = None) -> DataFrame:
    """Trusted sites by their place in the list, then the others in their order; `rank` from 1, the first `top` kept."""
    listed = small(priority.groupBy(F.col("site").alias(domain)).agg(F.min("place").alias("_place")))
    w = Window.partitionBy(query_id).orderBy(F.coalesce("_place", F.lit(LAST)), position)
    out = df.join(listed, domain, "left").withColumn("rank", F.row_number().over(w)).drop("_place")
    return out if top is None else out.filter(F.col("rank") <= top)


def band_rank(df: DataFrame, query_id: str, bands: list[Column], position: str) -> DataFrame:
    """Rows by the first band whose condition holds (the rest last), by position inside each; `rank` from 1."""
    band = F.when(bands[0], 0)
    for k, condition in enumerate(bands[1:], 1):
        band = band.when(condition, k)
    return df.withColumn("band", band.otherwise(len(bands))).withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("band", position)))


def promote_top(df: DataFrame, query_id: str, trusted: Column, position: str, n: int = 5) -> DataFrame:
    """The first n trusted rows, then all others, then the remaining trusted ones."""
    inside = F.row_number().over(Window.partitionBy(query_id, trusted).orderBy(position))
    band = F.when(trusted & (F.col("_in") <= n), 0).when(~trusted, 1).otherwise(2)
    return df.withColumn("_in", inside).withColumn("band", band).withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("band", position))).drop("_in")


def domain_quota(df: DataFrame, query_id: str, domain: str, rank: str, quota: int = 2, used: DataFrame | None = None) -> DataFrame:
    """At most `quota` rows per query and domain in rank order, counting what `used` (query, domain, used) already took."""
    nth = F.row_number().over(Window.partitionBy(query_id, domain).orderBy(rank))
    if used is None:
        return df.withColumn("_n", nth).filter(F.col("_n") <= quota).drop("_n")
    return df.withColumn("_n", nth).join(used, [query_id, domain], "left").filter(F.col("_n") + F.coalesce("used", F.lit(0)) <= quota).drop("_n", "used")


def _deal(counts: list[int], size: int, per_domain: int) -> list[tuple[int, int, int, int]]:
    """(domain, first row, first batch, rows per batch) of runs of batches. Batches are kept as runs (length, room), the last endless."""
    runs: list[list[int]] = [[1 << 62, size]]
    out = []
    for d, left in enumerate(counts):
        at, row, fresh = 0, 0, []
        for k, (length, room) in enumerate(runs):
            take = min(per_domain, room)
            full = min(length, left // take) if take and left else 0
            if full:
                out.append((d, row, at, take))
                fresh.append([full, room - take])
                row, left = row + full * take, left - full * take
            if left and take and full < length:
                # fewer rows than a batch would take: the domain ends here
                out.append((d, row, at + full, left))
                fresh.append([1, room - left])
                full, left = full + 1, 0
            if full < length:
                fresh.append([length - full, room])
            at += length
            if not left:
                fresh += runs[k + 1 :]
                break
        runs = []
        for length, room in fresh:
            if runs and runs[-1][1] == room:
                runs[-1][0] += length
            else:
                runs.append([length, room])
    return out


def interleaved_batches(df: DataFrame, query_id: str, domain: str, trusted: str, rank: str, size: int = 10, per_domain: int = 2) -> DataFrame:
    """`batch` from 1: every batch goes through the domains that have rows left, trusted ones first, then by name, and takes up to
    `per_domain` rows of each until it has `size`.

    Only the counts per domain are dealt, in a task per group of queries, linear in the domains; rows find their batch by a join with
    the few runs of their domain. Rows without a domain are one domain.
    """
    counts = df.groupBy(query_id, F.coalesce(domain, F.lit("")).alias("_d")).agg(F.count(F.lit(1)).alias("_c"), F.max(trusted).alias("_t"))
    kind = df.schema[query_id].dataType.simpleString()

    def deal(table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=lambda k: (not table["_t"][k].as_py(), table["_d"][k].as_py()))
        runs = _deal([table["_c"][k].as_py() for k in order], size, per_domain)
        names = pa.array([table["_d"][order[d]].as_py() for d, *_ in runs], pa.string())
        numbers = [pa.array([r[k] for r in runs], pa.int64()) for k in (1, 2, 3)]
        return pa.table([table[query_id].take(pa.array([0] * len(runs), pa.int32())), names, *numbers], [query_id, "_d", "_row", "_from", "_per"])

    plan = counts.groupBy(query_id).applyInArrow(deal, f"{query_id} {kind}, _d string, _row long, _from long, _per long")
    runs = plan.groupBy(query_id, "_d").agg(F.array_sort(F.collect_list(F.struct("_row", "_from", "_per"))).alias("_runs"))
    numbered = df.withColumn("_d", F.coalesce(domain, F.lit(""))).withColumn("_n", F.row_number().over(Window.partitionBy(query_id, "_d").orderBy(rank)) - 1)
    run = F.element_at(F.filter("_runs", lambda x: x["_row"] <= F.col("_n")), -1)
    joined = numbered.join(runs, [query_id, "_d"]).withColumn("_run", run)
    return joined.withColumn("batch", F.expr("(_run._from + (_n - _run._row) div _run._per + 1)").cast("int")).drop("_d", "_n", "_runs", "_run")


def early_exit(df: DataFrame, query_id: str, position: str, ok: Column, passed: Column, good: Column, tried: Column | None = None, min_good: int = 3, max_good: int = 5, cap: int = 15) -> DataFrame:
    """Rows up to each query's stop, with `n`, their number among those tried.

    Of the first `cap` rows those are tried that `tried` holds for. A good row (parsed, gate passed, score reached) ends the
    query once `max_good` are found, or `min_good` after eight tries of which 0.6 were parsed and 0.4 of the parsed ones good. A row
    that passed the gate aborts it after ten tries of which fewer than 0.3 were parsed. Other rows are counted, but end nothing.
    """
    by = Window.partitionBy(query_id).orderBy(position)
    yes = lambda c: F.coalesce(c, F.lit(False))
    # only the first `cap` rows of a query can matter; as a rank limit this is applied before the shuffle
    capped = df.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= cap)
    marked = capped.filter(yes(tried) if tried is not None else F.lit(True)).withColumns({"_ok": yes(ok), "_passed": yes(ok) & yes(passed)}).withColumn("_good", F.col("_passed") & yes(good))
    w = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.withColumns({"n": F.count(F.lit(1)).over(w), "_n_ok": F.count_if("_ok").over(w), "_n_good": F.count_if("_good").over(w)})
    n, n_ok, n_good = F.col("n"), F.col("_n_ok"), F.col("_n_good")
    enough = F.col("_good") & (n_good >= min_good) & ((n_good >= max_good) | ((n >= 8) & (n_ok / n >= 0.6) & (n_good / F.greatest(n_ok, F.lit(1)) >= 0.4)))
    abort = F.col("_passed") & (n >= 10) & (n_ok / n < 0.3)
    stop = F.min(F.when(enough | abort, n)).over(Window.partitionBy(query_id))
    return rows.withColumn("_stop", F.coalesce(stop, F.lit(cap))).filter(n <= F.col("_stop")).drop("_ok", "_passed", "_good", "_n_ok", "_n_good", "_stop")


def batch_cutoff(df: DataFrame, query_id: str, batch: str, domain: str, rows: int, domains: int) -> DataFrame:
    """Rows up to the first batch where the rows so far reach `rows` and their domains `domains`."""
    first = df.groupBy(query_id, domain).agg(F.min(batch).alias(batch)).groupBy(query_id, batch).agg(F.count(F.lit(1)).alias("_d"))
    per = df.groupBy(query_id, batch).agg(F.count(F.lit(1)).alias("_n")).join(first, [query_id, batch], "left")
    w = Window.partitionBy(query_id).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    done = per.withColumns({"_cn": F.sum("_n").over(w), "_cd": F.sum(F.coalesce("_d", F.lit(0))).over(w)}).filter((F.col("_cn") >= rows) & (F.col("_cd") >= domains)).groupBy(query_id).agg(F.min(batch).alias("_stop"))
    return df.join(done, query_id, "left").filter(F.col("_stop").isNull() | (F.col(batch) <= F.col("_stop"))).drop("_stop")


def exact_then_closest(df: DataFrame, query_id: str, item: str, exact: str, pct: str, n: int) -> DataFrame:
    """All exact rows, then the best partial ones above 0 % until n rows."""
    band = F.when(F.col(exact), 0).otherwise(1)
    ranked = df.filter(F.col(exact) | (F.col(pct) > 0)).withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(band, F.desc(pct), item)))
    return ranked.filter(F.col(exact) | (F.col("rank") <= n)).withColumn("closest_match", ~F.col(exact))


def section_fill(df: DataFrame, doc: str, step: str, is_header: Column, text: str) -> DataFrame:
    """`section`: the latest header at or before each step."""
    w = Window.partitionBy(doc).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("section", F.last(F.when(is_header, F.col(text)), ignorenulls=True).over(w))


def union_ordered(parts: list[tuple[str, DataFrame]], keys: list[str], position: str, filled: str) -> DataFrame:
    """Parts one after the other, each key's first occurrence, with `origin`."""
    banded = [df.withColumns({"band": F.lit(k), "origin": F.lit(name)}) for k, (name, df) in enumerate(parts)]
    every = banded[0]
    for df in banded[1:]:
        every = every.unionByName(df)
    return keep_first(every, keys, ["band", position], filled)


def closest(df: DataFrame, query_id: str, key: str, pct: str, n: int = 3) -> DataFrame:
    """The `n` rows of each query with the highest match above 0 percent, ties by the key."""
    k = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(pct), key))
    return df.filter(F.col(pct) > 0).withColumn("_k", k).filter(F.col("_k") <= n).drop("_k")


def score_trend(df: DataFrame, key: str, order: list[str], score: str) -> DataFrame:
    """improving, declining or stable by the last two scores of each key; insufficient_data with fewer than two."""
    place = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    last = df.filter(F.col(score).isNotNull()).withColumn("_k", F.row_number().over(place)).filter("_k <= 2")
    two = last.groupBy(key).agg(F.max(F.when(F.col("_k") == 1, F.col(score))).alias("_new"), F.max(F.when(F.col("_k") == 2, F.col(score))).alias("_old"))
    trend = F.when(F.col("_old").isNull(), "insufficient_data").when(F.col("_new") > F.col("_old"), "improving").when(F.col("_new") < F.col("_old"), "declining").otherwise("stable")
    return df.select(key).distinct().join(two, key, "left").select(key, trend.alias("trend"))
