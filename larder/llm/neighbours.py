"""Nearest neighbours by inner product: a block matrix join over int8 codes with error bounds, and exact scores of what survives.

A vector x becomes codes c (int8) and a step s with x = s c + r. For two vectors, |<x, y> - s s' <c, c'>| is at most
|r| |s' c'| + |x| |r'|, so a tile of integer products (exact in floating point) gives each pair a lower and an upper bound. Within a
tile a pair whose upper bound is below the k-th largest lower bound of its query, or below the k-th best exact score so far, can't be
among the k nearest. What survives is computed in double precision from the original vectors, summed in the order of the components,
and goes to a heap of k per query. The result is exact: nothing is sampled and no index is approximated.

Queries are dealt to blocks, candidates to strips; each task holds a block of queries (at most about `block` of them) and streams the
candidates of one strip in batches. There are as many strips as it takes to keep all cores busy: with many query blocks there
is one, and each candidate crosses the exchange once per block. With several strips, their heaps are merged by query. Equal vectors of
a batch are reduced to the k + 1 with the smallest ids before anything is computed, so a vector that a third of the rows share
costs no more than others.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as query nor as
candidate. Vectors of different lengths are never compared. Rows are told apart by row: rows with one id are candidates
of each other, and a repeated query row has a result of its own. A null id is no query; as a candidate it comes after all ids of an
equal score. Ties go to the smaller id, then to the earlier row. An empty table gives an empty result, a lone vector no row. Other
columns are ignored. A very long vector must fit a row, and `block` of them a task; lower `block` for more than a few thousand components.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import ROW, staged

CODED = f"{ROW} long, id long, query boolean, vector binary, code binary, step double, norm double, code_norm double, rest double"
#: Queries and candidates of one tile of products.
TILE_QUERIES, TILE_CANDIDATES = 512, 4096
#: Numbers that the exact scores of survivors hold at once, about.
EXACT_NUMBERS = 1 << 21
#: A null id sorts behind all ids.
LAST = np.iinfo(np.int64).max


def takes_part(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def coded(vectors: DataFrame, id: str, vector: str, query: Column) -> DataFrame:
    """The vectors that take part, with their codes, norms and a row number, in a scratch table."""
    kind = "f4" if dict(vectors.dtypes)[vector] == "array<float>" else "f8"
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("query"), (v if kind == "f4" else v.cast("array<double>")).alias("v"))
    rows = rows.filter(takes_part(F.col("v"))).withColumn(ROW, F.monotonically_increasing_id())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("v"):
                x = np.asarray(x.values, kind)
                d = x.astype(np.float64)
                step = np.abs(d).max() / 127
                c = np.rint(d / step).astype(np.int8) if step > 0 else np.zeros(len(d), np.int8)
                back = step * c
                out.append((x.tobytes(), c.tobytes(), step, np.linalg.norm(d), np.linalg.norm(back), np.linalg.norm(d - back)))
            kinds = [pa.binary(), pa.binary(), *[pa.float64()] * 4]
            more = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(ROW), b.column("id"), b.column("query"), *more], [f.split()[0] for f in CODED.split(", ")])

    return staged(rows.mapInArrow(code, CODED), "vectors")


@dataclass
class Block:
    """Vectors of one length as arrays."""

    row: np.ndarray
    id: np.ndarray
    vector: np.ndarray
    code: np.ndarray
    step: np.ndarray
    norm: np.ndarray
    code_norm: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], kind: str) -> dict[int, Block]:
        """A block for each length in the batches."""
        table = pa.Table.from_batches(batches)
        codes, vectors = table.column("code").to_pylist(), table.column("vector").to_pylist()
        lengths = np.array([len(c) for c in codes], np.int64)
        row, ids = table.column(ROW).to_numpy(), table.column("id").fill_null(LAST).to_numpy()
        out = {}
        for n in np.unique(lengths).tolist():
            k = np.flatnonzero(lengths == n)
            # products of codes are below 2**14, so sums of up to 1,024 are whole numbers in single precision
            code = np.frombuffer(b"".join(codes[i] for i in k), np.int8).reshape(-1, n).astype(np.float32 if n <= 1024 else np.float64)
            vector = np.frombuffer(b"".join(vectors[i] for i in k), kind).reshape(-1, n).astype(np.float64)
            out[n] = cls(row[k], ids[k], vector, code, *[table.column(c).to_numpy()[k] for c in ("step", "norm", "code_norm", "rest")])
        return out

    def take(self, k: np.ndarray) -> Block:
        return Block(*[x[k] for x in (self.row, self.id, self.vector, self.code, self.step, self.norm, self.code_norm, self.rest)])

    def least_of_equal(self, most: int) -> Block:
        """Of equal vectors, the `most` with the smallest ids."""
        same = np.ascontiguousarray(self.vector).view(np.dtype((np.void, 8 * self.vector.shape[1]))).ravel()
        kinds, group = np.unique(same, return_inverse=True)
        if len(kinds) == len(same):
            return self
        order = np.lexsort((self.row, self.id, group))
        first = np.searchsorted(group[order], group[order])
        return self.take(np.sort(order[np.arange(len(order)) - first < most]))


def exact_scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of a[i] and b[j], summed from the first component to the last."""
    out = np.empty(len(i))
    at_once = max(1, EXACT_NUMBERS // a.shape[1])
    for k in range(0, len(i), at_once):
        s = slice(k, k + at_once)
        out[s] = np.cumsum(a[i[s]] * b[j[s]], axis=1)[:, -1]
    return np.where(np.isnan(out), -np.inf, out)


@dataclass
class Search:
    """The k best candidates so far of each query of a block, as heaps whose first entry is the worst."""

    queries: Block
    k: int
    heaps: list[list[tuple]] = field(init=False)
    worst: np.ndarray = field(init=False)

    def __post_init__(self):
        order = np.argsort(self.queries.row)
        self.queries = self.queries.take(order)
        self.heaps = [[] for _ in order]
        self.worst = np.full(len(order), -np.inf)

    def meet(self, candidates: Block) -> None:
        candidates = candidates.least_of_equal(self.k + 1)
        for c in range(0, len(candidates.row), TILE_CANDIDATES):
            part = candidates.take(np.arange(c, min(c + TILE_CANDIDATES, len(candidates.row))))
            for q in range(0, len(self.queries.row), TILE_QUERIES):
                self._tile(q, min(q + TILE_QUERIES, len(self.queries.row)), part)

    def _tile(self, a: int, b: int, c: Block) -> None:
        q = self.queries
        with np.errstate(over="ignore", invalid="ignore"):
            about = (q.code[a:b] @ c.code.T).astype(np.float64)
            about *= q.step[a:b, None]
            about *= c.step
            slack = (4 * q.vector.shape[1] + 64) * np.finfo(np.float64).eps
            error = np.outer(q.rest[a:b], c.code_norm)
            error += np.outer(q.norm[a:b], c.rest + slack * c.norm)
            upper = about + error
            about -= error  # now the lower bound
        at = np.searchsorted(q.row[a:b], c.row)
        own = np.flatnonzero((at < b - a) & (q.row[a:b][np.minimum(at, b - a - 1)] == c.row))
        upper[at[own], own] = about[at[own], own] = -np.inf
        floor = self.worst[a:b]
        if about.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(np.where(np.isnan(about), -np.inf, about), -self.k, axis=1)[:, -self.k])
        live = ~(upper < floor[:, None])  # a bound that overflowed prunes nothing
        live[at[own], own] = False
        i, j = np.nonzero(live)
        score = exact_scores(q.vector[a:b], c.vector, i, j)
        on = score >= self.worst[a:b][i]
        i, j, score = i[on], j[on], score[on]
        order = np.lexsort((c.row[j], c.id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        i, j, score = i[best], j[best], score[best]
        for n, s, x, row in zip((i + a).tolist(), score.tolist(), c.id[j].tolist(), c.row[j].tolist(), strict=True):
            heap, entry = self.heaps[n], (s, -x, -row)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                continue
            if len(heap) == self.k:
                self.worst[n] = heap[0][0]

    def found(self) -> pa.RecordBatch:
        """A row for each query and candidate."""
        flat = [(n, *e) for n, heap in enumerate(self.heaps) for e in heap]
        n = np.array([f[0] for f in flat], np.int64)
        ids = np.array([-f[2] for f in flat], np.int64)
        columns = [pa.array(self.queries.row[n]), pa.array(self.queries.id[n]), pa.array([f[1] for f in flat], pa.float64()), pa.array(ids, mask=ids == LAST), pa.array([-f[3] for f in flat], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["query_row", "query_id", "score", "id", "row"])


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of one tile and side each."""
    key = 2 * batch.column("_tile").to_numpy() + batch.column("_side").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def nearest(vectors: DataFrame, query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", block: int = 16_384, cores: int | None = None) -> DataFrame:
    """query_id, rank (from 1), id and score of the k candidates with the largest inner product, for each row that `query` holds for."""
    spark = vectors.sparkSession
    kind = "f4" if dict(vectors.dtypes)[vector] == "array<float>" else "f8"
    rows = coded(vectors, id, vector, query & F.col(f"`{id}`").isNotNull())
    blocks = max(1, -(-rows.filter("query").count() // block))
    strips = max(1, -(-(cores or spark.sparkContext.defaultParallelism) // blocks))
    dealt = lambda n: F.pmod(F.xxhash64(ROW), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.filter("query").withColumn("_block", dealt(blocks)).withColumn("_strip", every(strips)).withColumn("_side", F.lit(0))
    held = rows.withColumn("_strip", dealt(strips)).withColumn("_block", every(blocks)).withColumn("_side", F.lit(1))
    both = asked.unionByName(held).withColumn("_tile", F.col("_block") * strips + F.col("_strip")).drop("_block", "_strip", "query")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, waiting, searches = None, [], {}
        for batch in batches:
            for part in _runs(batch):
                if tile != (now := part.column("_tile")[0].as_py()):
                    yield from (s.found() for s in searches.values())
                    tile, waiting, searches = now, [], {}
                if part.column("_side")[0].as_py() == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    searches = {n: Search(b, k) for n, b in Block.of(waiting, kind).items()}
                    waiting = []
                for n, candidates in Block.of([part], kind).items():
                    if n in searches:
                        searches[n].meet(candidates)
        yield from (s.found() for s in searches.values())

    found = both.repartitionById(blocks * strips, F.col("_tile")).sortWithinPartitions("_tile", "_side").mapInArrow(search, "query_row long, query_id long, score double, id long, row long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
