"""Sharding by histogram sort: shards of near equal bytes, in key order.

Key of a row: the upper 40 bits of a hash of the text, then 23 bits of a hash of doc_id. Equal texts are therefore
neighbours, and a group of copies can still be cut. The splitters between shards are found by counting: each round, every
open splitter sends probes into its interval, all partitions count the exact bytes below the probes at once, and the
interval shrinks to the two probes around the target. A splitter closes when it is within `tolerance` of a shard's size,
between two groups where possible; only a group too large for that is cut inside. Then the rows are exchanged once.

The driver holds `probes` numbers per splitter and one per `rows_per_range` rows; a task adds its counts up before it sends
them. A shard's slots are numbered in ranges of the counted probes. Groups of more than `rows_per_range` equal texts (there are
at most n / rows_per_range) are found by counting and get probes inside from the start, and a range that is still longer is probed
again, so no task sorts much more than `rows_per_range` rows, unless more of them share a key, which takes the same text and the
same 23 bits of the doc_id's hash.

Defined cases: null text has no bytes (size 8) and falls into the group of empty texts; null doc_id hashes like any value. Rows
with equal keys are ordered by doc_id, then by the text's hash; rows that repeat a doc_id get slots of their own. A very long text counts by its
bytes like any other; a shard may then be larger by one text. An empty table gives an empty result. Columns of the input named
like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import free_names, staged, text_or_empty

DOC_BITS = 23
KEY_END = 1 << 63


def shard_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    group = F.shiftrightunsigned(F.xxhash64(text_or_empty(text)), 24)
    return F.shiftleft(group, DOC_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 64 - DOC_BITS))


def row_size(text: str = "text") -> Column:
    return (F.octet_length(text_or_empty(text)) + 8).cast("long")


def count_below(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows with a key below each of the sorted probes; `keys` has key and size."""
    edges = np.array(probes, dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(edges, b.column("key").to_numpy(zero_copy_only=False), side="right")
            np.add.at(size, at, b.column("size").to_numpy(zero_copy_only=False))
            rows += np.bincount(at, minlength=len(edges) + 1)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(size[full]), pa.array(rows[full])], ["bin", "size", "rows"])

    parts = keys.select("key", "size").mapInArrow(count, "bin int, size long, rows long").groupBy("bin").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for r in parts:  # a row per probe at most
        size[r["bin"]], rows[r["bin"]] = r["size"], r["rows"]
    return np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float, probes: int, rows_per_range: int) -> tuple[list[int], dict[int, int]]:
    """The n_shards - 1 splitters, and rows below for every probe that was counted."""
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    below, rows_below = {0: 0, KEY_END: total}, {0: 0, KEY_END: n}
    targets = [total * k // n_shards for k in range(1, n_shards)]
    slack = tolerance * total / n_shards / 2
    low, high = [0] * len(targets), [KEY_END] * len(targets)
    unit = 1 << DOC_BITS
    grid = max(n_shards * probes, n // rows_per_range)
    ask = {KEY_END * j // grid // unit * unit for j in range(1, grid)} if n else set()
    # at most n / rows_per_range groups; equal steps inside, since the lower bits are a hash
    group = F.shiftright("key", DOC_BITS)
    for r in keys.groupBy(group.alias("g")).count().filter(F.col("count") > rows_per_range).collect():
        parts = 2 * (-(-r["count"] // rows_per_range))
        ask.update(r["g"] * unit + unit * j // parts for j in range(parts + 1))
    ask -= below.keys()
    while ask:
        ordered = sorted(ask)
        size, rows = count_below(keys, ordered)
        below |= dict(zip(ordered, size, strict=True))
        rows_below |= dict(zip(ordered, rows, strict=True))
        known = sorted(below)
        sizes = np.array([below[x] for x in known])
        ask = set()
        for k, target in enumerate(targets):
            i = int(np.searchsorted(sizes, target, side="right"))
            low[k], high[k] = a, b = known[i - 1], known[min(i, len(known) - 1)]
            if min(target - below[a], below[b] - target) <= slack or b - a <= 1:
                continue
            step = unit if b - a > unit else 1  # between groups first, inside one group last
            inner = range(a // step + 1, -(-b // step))
            if len(inner) <= probes:
                ask.update(x * step for x in inner)
            else:
                ask.update((a + (b - a) * (j + 1) // (probes + 1)) // step * step for j in range(probes))
        # long ranges are halved (in rows, if their keys are even) until they are short or a single key
        for a, b in zip(known[:-1], known[1:], strict=True):
            rows_in = rows_below[b] - rows_below[a]
            if rows_in > 2 * rows_per_range and b - a > 1:
                parts = min(b - a, max(probes, 2 * (rows_in // rows_per_range)))
                ask.update(a + (b - a) * j // parts for j in range(1, parts))
        ask -= below.keys()
    splitters = [a if target - below[a] <= below[b] - target else b for target, a, b in zip(targets, low, high, strict=True)]
    return splitters, rows_below


def histogram_shards(docs: DataFrame, n_shards: int = 24, tolerance: float = 0.02, probes: int = 32, text: str = "text", doc_id: str = "doc_id", rows_per_range: int = 200_000) -> DataFrame:
    """`docs` with size, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard, in key order)."""
    keys = staged(docs.select(shard_key(text, doc_id).alias("key"), row_size(text).alias("size")), "shard-keys")
    splitters, rows_below = find_splitters(keys, n_shards, tolerance, probes, rows_per_range)
    # ranges for numbering: the counted probes, thinned to about rows_per_range rows each, and the splitters
    starts = {0, *splitters}
    last = 0
    for key, rows in sorted(rows_below.items()):
        if key in starts or rows - last >= rows_per_range:
            starts.add(key)
            last = rows
    starts = sorted(x for x in starts if x < KEY_END)
    first_of = [0, *splitters]
    ranges = []
    for k, start in enumerate(starts):
        shard = sum(c <= start for c in splitters)
        ranges.append((k, shard, rows_below[start] - rows_below[first_of[shard]]))
    kept = [c for c in docs.columns if c not in {"size", "shard", "slot"}]
    key, tie, of, row, before = free_names(docs.select(*[F.col(f"`{c}`") for c in kept]), "_key", "_tie", "_range", "_row", "_before")
    place = docs.sparkSession.createDataFrame(ranges, f"`{of}` int, shard int, `{before}` long")

    edges = np.array(starts, dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(key):
        import pandas as pd

        return pd.Series(np.searchsorted(edges, key.to_numpy(), side="right").astype(np.int32) - 1)

    shown = [F.col(f"`{c}`") for c in kept]
    placed = docs.select(*shown, row_size(text).alias("size"), shard_key(text, doc_id).alias(key), F.xxhash64(text_or_empty(text)).alias(tie)).withColumn(of, range_of(key))
    order = Window.partitionBy(of).orderBy(key, doc_id, tie)
    # the place table has a row per range: a few per splitter and one per rows_per_range rows
    return placed.withColumn(row, F.row_number().over(order)).join(place, of).select(*shown, "size", "shard", (F.col(before) + F.col(row) - 1).alias("slot"))
