"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are put in a hashed order and cut into blocks of `block_rows` rows, each scheduled as two halves (units). A slot
holds one unit. In every period each unit gets a release time and a deadline from its source's weight, and the earliest deadline
goes first (of equal ones, that whose window overlaps the next, then the later group deadline, then the source), so after each slot
a source is less than one unit away from the straight line of its period.

The weights are taken as they are, not rounded to a period: the number of units that a source has got at a period's end is its
weight times the slots so far, rounded by largest remainder over the whole past, so what one period owes, the next one pays. That
is less than one unit off, too. Together a source is less than one block away from its target weight after every slot, for any
number of periods. A period has at least `period` slots, and as many as it takes for every source to be due a unit. It is scheduled
as a stream: a task holds one entry per source, however long the period.

This holds until the first source runs out (slot `end` of the plan). Then the others go on in proportion to their weights, spread
evenly in each period, until all units are placed: there are as many slots as units, none stays empty, and no row is dropped.
`in_mix` marks the rows before that slot, or before `slots` units if given.

The driver and each scheduling task hold three numbers per source, whatever the number of sources; none is merged. Periods are
scheduled apart from each other, in tasks; their slots meet the units by a join. Rows are numbered within a source in two steps, by
bucket and inside it, on narrow columns, and the rest of a row comes back by its number. A source with a large share of all rows
is joined by broadcast.

Defined cases: null source is a source of its own. A source of weight 0 (or missing in `weights`) has no slots: its rows get null
in slot, release and deadline, and in_mix is false. Ties of hash and doc_id go by a hash of the whole row; rows equal in all
columns are interchangeable. Null and repeated doc_ids are rows like others. An empty table gives an empty result. Columns of
the input named like output columns are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import ROW, buckets_for, join_groups, numbered, packed, staged

PERIOD = 8_192
#: Slots per Arrow batch of a schedule.
BATCH = 65_536
OUTPUT = ("block", "release", "deadline", "slot", "in_mix")


def schedule(quota: dict, period: int) -> Iterator[tuple]:
    """(source, k, slot) by slot: the slot of each source's k-th unit, k from 0, in one period. Uses PD2 priorities."""

    def window(s, k):
        q = quota[s]
        release, deadline = k * period // q, -(-(k + 1) * period // q)
        overlaps = (k + 1) * period % q != 0
        group = deadline
        if overlaps and 2 * q > period:  # heavy: the first slot where a cascade of tight windows must end
            idle = period - q
            group = -(-(-(-(deadline * idle) // period)) * period // idle) if idle else 1 << 60
        return release, deadline, overlaps, group

    waiting = [(0, n, s, 0) for n, s in enumerate(sorted(quota, key=str))]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, n, s, k = heapq.heappop(waiting)
            _, deadline, overlaps, group = window(s, k)
            heapq.heappush(ready, (deadline, not overlaps, -group, n, s, k))
        *_, n, s, k = heapq.heappop(ready)
        yield s, k, slot
        if k + 1 < quota[s]:
            heapq.heappush(waiting, (max(window(s, k + 1)[0], slot + 1), n, s, k + 1))


def target_weights(rows: dict, temperature: float) -> dict:
    """Weights in proportion to rows ** temperature: 1 keeps the input's shares, 0 makes all sources equal."""
    return {s: n**temperature for s, n in rows.items()}


@dataclass
class Plan:
    """Units a source gets over time. `weight` and `units` (both above 0) are per source."""

    weight: np.ndarray
    units: np.ndarray
    period: int = PERIOD

    def __post_init__(self):
        self.weight = np.asarray(self.weight, float) / max(float(np.sum(self.weight)), 1e-300)
        self.units = np.asarray(self.units, np.int64)
        self.total = int(self.units.sum())
        if not self.total:
            self.end, self.bounds = 0, np.zeros(1, np.int64)
            return
        runs_out = self.units / self.weight
        self.order = np.argsort(runs_out, kind="stable")
        at = runs_out[self.order]
        # slots so far when the sources run out, one after the other: those gone, plus what the others got by then
        gone = np.concatenate([[0], np.cumsum(self.units[self.order])])
        left = np.concatenate([np.cumsum(self.weight[self.order][::-1])[::-1], [0.0]])
        self.virtual = np.concatenate([[0.0], at])
        self.real = np.concatenate([[0.0], gone[1:] + at * left[1:]])
        self.end = min(int(runs_out.min() + 1e-9), self.total)
        length = int(min(max(self.period, np.ceil(1 / self.weight.min())) + 1, self.total))
        parts = [np.linspace(a, z, max(1, (z - a) // length) + 1).round().astype(np.int64) for a, z in ((0, self.end), (self.end, self.total)) if z > a]
        self.bounds = np.unique(np.concatenate(parts))

    def fluid(self, slots: int) -> np.ndarray:
        """Units per source after `slots` slots if they could be cut at will."""
        if slots <= self.end:
            return np.minimum(self.weight * slots, self.units)
        return np.minimum(self.weight * np.interp(slots, self.real, self.virtual), self.units)

    def done(self, slots: int) -> np.ndarray:
        """Whole units per source after `slots` slots, `slots` in all: the fluid by largest remainder."""
        exact = self.fluid(slots)
        whole = np.where(np.abs(exact - np.rint(exact)) < 1e-6, np.rint(exact), np.floor(exact)).astype(np.int64)
        rest = np.where(whole < self.units, exact - whole, -1.0)
        more = np.argsort(-rest, kind="stable")[: max(0, slots - int(whole.sum()))]
        whole[more] += 1
        return whole

    def slots(self, k: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(source, unit, slot, release, deadline) of period k."""
        start, stop = int(self.bounds[k]), int(self.bounds[k + 1])
        before = self.done(start)
        got = self.done(stop) - before
        length = stop - start
        quota = {int(s): int(got[s]) for s in np.flatnonzero(got > 0)}
        for s, unit, at in schedule(quota, length):
            q = quota[s]
            yield s, int(before[s]) + unit, start + at, start + unit * length // q, start - (-(unit + 1) * length // q)


def planned(spark, plan: Plan) -> DataFrame:
    """(stream, unit, slot, release, deadline) of all units; periods are dealt to tasks."""
    n = len(plan.bounds) - 1
    schema = "stream int, unit long, slot long, release long, deadline long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                for part in batched(plan.slots(k), BATCH):
                    columns = list(zip(*part, strict=True))
                    types = [pa.int32(), *[pa.int64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["stream", "unit", "slot", "release", "deadline"])

    return spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, block_rows: int = 16, slots: int | None = None, period: int = PERIOD, source: str = "source", doc_id: str = "doc_id", rows_per_bucket: int = 1_000, ordered: bool = False) -> DataFrame:
    """`docs` with block (from 1, in the source), release, deadline and slot (of the row's half block) and in_mix.

    If `ordered`, rows lie by slot, then doc_id, those without a slot last: each partition has an equal range of slots, known from
    the plan, so nothing is sampled or sorted beyond a partition.
    """
    spark = docs.sparkSession
    half = max(1, block_rows // 2)
    base = numbered(packed(docs), "mix-rows")
    name, of_row = F.col("_d").getField(source).cast("string"), F.col("_d").getField(doc_id)
    keys = ["_null", "_name"]
    narrow = base.select(ROW, name.isNull().alias("_null"), F.coalesce(name, F.lit("")).alias("_name"), of_row.alias("_id"), "_tie", F.xxhash64(of_row, name).alias("_hash"))
    counts = {(r["_null"], r["_name"]): r["count"] for r in narrow.groupBy(*keys).count().collect()}  # a row per source
    names = sorted(counts)
    if weights is None:
        weight = target_weights(counts, temperature)
    else:
        weight = {k: max(0.0, float(weights.get(None if k[0] else k[1], 0))) for k in names}
    live = [k for k in names if weight[k] > 0]
    plan = Plan(np.array([weight[k] for k in live]), np.array([-(-counts[k] // half) for k in live], np.int64), period)
    index = {k: j for j, k in enumerate(live)}
    listed = [(*k, index.get(k), counts[k], buckets_for(counts[k], rows_per_bucket)) for k in names]
    streams = spark.createDataFrame(listed, "_null boolean, _name string, stream int, _size long, _buckets long")

    rows = join_groups(narrow, streams, keys, "_size", sum(counts.values())).withColumn("_bucket", F.pmod("_hash", "_buckets"))
    rows = staged(rows.select(ROW, *keys, "stream", "_bucket", "_hash", "_id", "_tie"), "mix-dealt")
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # a row per `rows_per_bucket` rows of a source
    running = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    before = sizes.withColumn("_before", running - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_hash", "_id", "_tie", ROW)) - 1
    placed = rows.withColumn("_inside", inside).join(before, [*keys, "_bucket"]).withColumn("_nth", F.col("_before") + F.col("_inside"))
    units = placed.select(ROW, "stream", F.expr(f"_nth div {half}").alias("unit"), F.expr(f"_nth div {2 * half} + 1").alias("block"))
    timed = units.join(planned(spark, plan), ["stream", "unit"], "left")
    limit = plan.end if slots is None else int(slots)
    timed = timed.select(ROW, "block", "release", "deadline", "slot", F.coalesce(F.col("slot") < limit, F.lit(False)).alias("in_mix"))
    kept = [F.col("_d").getField(c).alias(c) for c in docs.columns if c not in OUTPUT]
    mixed = base.join(timed, ROW)
    if ordered:
        files = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        span = max(1, -(-plan.total // files))
        part = F.coalesce(F.expr(f"slot div {span}"), F.lit(files - 1)).cast("int")
        mixed = mixed.repartitionById(files, part).sortWithinPartitions(F.asc_nulls_last("slot"), of_row, "_tie")
    return mixed.select(*kept, *OUTPUT)
