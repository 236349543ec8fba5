"""MinHash near-dedup with ProbMinHash signatures for weighted shingles.

A text's elements are its shingles of five words, weighted by how often they occur (a shorter text is one shingle). Each
element runs a Poisson process whose rate is its weight: arrivals come at exponential distances, every arrival
picks a register at random, and a register keeps the element that reached it first. The processes of a text stop when their next
arrival is later than the latest register, since nothing can change any more. Two registers agree with the probability
Jaccard similarity of the weighted sets, which for weights of 1 is the Jaccard similarity.

Texts with equal word sequences form a class at once; only the smallest doc_id of a class goes on. Registers are cut into bands;
class representatives that agree in a band are candidates. Within a bucket a pivot is compared with the other members, exactly,
over all shingles; links join members to groups, and a bucket whose members are all in one group is done. What other buckets
leave open is compared in blocks inside tasks, which give out links only. The groups are those of comparing all pairs that share a
band; no bucket is expanded into its pairs, and no size is capped. A bucket whose members are alike in a band but not in their
shingles costs a comparison per pair of members, as any exact check of its candidates must.

Work goes by row number, not by doc_id. Groups, classes and buckets that many rows share are joined by broadcast of the frequent
ones (at most 2,000), so none of them meets in one task.

Defined cases: texts without words are no near-duplicates of other texts, but of each other (one class). Null text has no
words. Exactly one row of a group stays: that of the smallest doc_id, a null doc_id being larger than any other; of rows that
share that doc_id, the one of the smallest hash of the whole row (rows equal in all columns are interchangeable). So rows of one
doc_id with different texts live and die apart; class_id and group_id are null where all doc_ids are. A text of any length is
compared by all its shingles; it must fit a row. Empty tables give empty results. Extra columns pass through `keep_one` and are
ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ROW, join_groups, numbered, packed, staged, unpacked
from larder.llm.words import Words, chunks, gram_hashes, mixed, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
#: Members of a bucket that a task compares with as many others at most.
BLOCK = 256
#: Pairs of one pivot that a task checks, about.
PAIRS = 256
#: Links that one task joins up at most.
ONE_TASK = 2_000_000


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all shingles; a text of fewer than k words, but one at least, has one of all its words."""
    counts = np.diff(words.first)
    text = words.texts()
    grams = gram_hashes(words, k)
    whole = np.arange(len(grams)) + k <= words.first[1:][text]
    short = np.flatnonzero((counts > 0) & (counts < k))
    few = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = counts[short] > j
        few[has] = few[has] * np.uint64(0x9E3779B97F4A7C15) + words.hash[words.first[short[has]] + j]
    return np.concatenate([text[whole], short]), np.concatenate([grams[whole], mixed(few + counts[short].astype(np.uint64))])


def weighted(text: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, element) with counts, sorted by text and element."""
    order = np.lexsort((element, text))
    t, e = text[order], element[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (e[1:] != e[:-1])
    at = np.flatnonzero(new)
    return t[at], e[at], np.diff(np.append(at, len(t))).astype(np.float64)


def prob_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """Signatures, n_texts x registers; rows of texts without elements are 0."""
    time = np.full(n_texts * registers, np.inf)
    owner = np.zeros(n_texts * registers, np.uint64)
    at, latest = np.zeros(len(element)), np.full(n_texts, np.inf)
    arrival = 0
    while len(element):
        arrival += 1
        seed = np.uint64(arrival * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        draw = mixed(element + seed)
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        alive = at < latest[text]
        text, element, weight, at, draw = text[alive], element[alive], weight[alive], at[alive], draw[alive]
        target = text * registers + (mixed(draw ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, target, at)
        first = time[target] == at
        owner[target[first]] = element[first]
        touched = np.unique(text)
        latest[touched] = time.reshape(n_texts, registers)[touched].max(axis=1)
    return owner.reshape(n_texts, registers)


def signatures(rows: DataFrame, bands: int = BANDS, registers: int = ROWS) -> DataFrame:
    """(_row, class_hi, class_lo, buckets) of (_row, text): two hashes of the word sequence, and a bucket per band (empty: no
    words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for whole in batches:
            for b in chunks(whole, "text"):
                words = words_of(b.column("text"))
                n = b.num_rows
                t, e, w = weighted(*shingles(words))
                signed = prob_minhash(t, e, w, n, bands * registers).reshape(n, bands, registers)
                key = np.tile(band, (n, 1))
                for r in range(registers):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signed[:, :, r])
                position = np.arange(len(words.hash)) - np.repeat(words.first[:-1], np.diff(words.first)) + 1
                classes = []
                for salt in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5):
                    total = np.zeros(len(words.hash) + 1, np.uint64)
                    np.cumsum(mixed(words.hash + mixed(position.astype(np.uint64) * np.uint64(salt))), out=total[1:])
                    classes.append((total[words.first[1:]] - total[words.first[:-1]]).view(np.int64))
                has = np.diff(words.first) > 0
                ends = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(ROW), pa.array(classes[0]), pa.array(classes[1]), lists], [ROW, "class_hi", "class_lo", "buckets"])

    return rows.select(ROW, "text").mapInArrow(run, f"{ROW} long, class_hi long, class_lo long, buckets array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted elements, weights)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    both = (x > 0) & (y > 0)
    # sum over j of max(x_j / x_i, y_j / y_i): j with a larger ratio x / y count by x, the others by y
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(-ratio, kind="stable")
    xs, ys = np.concatenate([[0], np.cumsum(x[order])]), np.concatenate([[0], np.cumsum(y[order])])
    at = np.searchsorted(-ratio[order], -ratio[both], side="right")
    return float((1 / (xs[at] / x[both] + (ys[-1] - ys[at]) / y[both])).sum())


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, sim) of a scratch table of (a, b) pairs; texts are (_row, text).

    The text of `a` comes last and sorted, so a task hashes a pivot once per run of pairs. A pivot of many pairs comes in copies, one
    for each PAIRS of them, which go to different tasks."""
    counts = staged(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).withColumn("_copies", F.ceil(F.col("_n") / PAIRS).cast("int")), "pivot-counts")
    dealt = join_groups(pairs, counts, ["a"], "_n", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), "_copies").cast("int").alias("_copy"))
    right = dealt.join(texts.select(F.col(ROW).alias("b"), F.col("text").alias("text_b")), "b")
    pivots = counts.join(texts.select(F.col(ROW).alias("a"), F.col("text").alias("text_a")), "a").select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"))
    both = right.join(pivots, ["a", "_copy"]).select("a", "b", "text_a", "text_b")

    def sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        t, e, w = weighted(*shingles(words_of(column)))
        cut = np.searchsorted(t, np.arange(len(column) + 1))
        return [(e[i:j], w[i:j]) for i, j in zip(cut[:-1], cut[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for whole in batches:
            for b in chunks(whole, "text_b"):
                out = []
                ids = b.column("a").to_pylist()
                for k, other in enumerate(sets(b.column("text_b"))):
                    if ids[k] != last:
                        last, mine = ids[k], sets(b.column("text_a").slice(k, 1))[0]
                    out.append(similarity(mine, other))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], ["a", "b", "sim"])

    return both.mapInArrow(run, "a long, b long, sim double")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(doc, elements, weights) of (_row, text): the sorted shingles of each text and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                t, e, w = weighted(*shingles(words_of(b.column("text"))))
                ends = pa.array(np.searchsorted(t, np.arange(b.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (e.view(np.int64), w.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column("doc"), *lists], ["doc", "elements", "weights"])

    return texts.select(F.col(ROW).alias("doc"), "text").mapInArrow(run, "doc long, elements array<long>, weights array<int>")


def block_links(left: pa.Table, right: pa.Table | None, threshold: float) -> list[tuple[int, int]]:
    """Links between different groups among `left`, or between `left` and `right`: enough to join all that are linked.

    Shared weight is counted by marking one text's elements and looking up all others at once. Where all weights are 1
    that gives the exact similarity; elsewhere it gives an upper bound, and what passes is computed.
    """
    both = left if right is None else pa.concat_tables([left, right])
    docs, roots = both.column("doc").to_pylist(), both.column("root").to_pylist()
    elements = both.column("elements").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(elements.value_lengths().to_numpy())])
    flat = elements.flatten().to_numpy().view(np.uint64)
    weight = both.column("weights").combine_chunks().flatten().to_numpy().astype(np.float64)
    _, number = np.unique(flat, return_inverse=True)
    mark = np.zeros(number.max(initial=-1) + 2)
    sizes = np.diff(ends)
    total = np.add.reduceat(np.append(weight, 0), ends[:-1]) * (sizes > 0)
    plain = total == sizes
    label: dict[int, int] = {}

    def find(k: int) -> int:
        while label.get(k, k) != k:
            k = label[k]
        return k

    out = []
    for k in range(left.num_rows):
        own = slice(ends[k], ends[k + 1])
        since = k + 1 if right is None else left.num_rows
        if since == len(docs) or not sizes[k]:
            continue
        others = slice(ends[since], None)
        mark[number[own]] = 1
        hit = mark[number[others]]
        starts = ends[since:-1] - ends[since]
        common = np.add.reduceat(np.append(hit, 0), starts) * (sizes[since:] > 0)
        theirs = np.add.reduceat(np.append(hit * weight[others], 0), starts) * (sizes[since:] > 0)
        mark[number[own]] = weight[own]
        mine = np.add.reduceat(np.append(mark[number[others]], 0), starts) * (sizes[since:] > 0)
        mark[number[own]] = 0
        exact = plain[k] & plain[since:]
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.where(exact, common / (sizes[k] + sizes[since:] - common), np.minimum(mine / total[k], theirs / total[since:]))
        for j in (np.flatnonzero(sim >= threshold - 1e-12) + since).tolist():
            p, q = find(roots[k]), find(roots[j])
            if p == q:
                continue
            if not exact[j - since]:
                at = slice(ends[j], ends[j + 1])
                if similarity((flat[own], weight[own]), (flat[at], weight[at])) < threshold - 1e-12:
                    continue
            label[max(p, q)] = min(p, q)
            out.append((docs[k], docs[j]))
    return out


def near_links(representatives: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root): groups of the representatives that share a bucket and reach the threshold, for all that share any.

    `representatives` are (_row, buckets), `texts` (_row, text). First every bucket's smallest member, its pivot, is compared
    with the others. Buckets that then hold members of several groups are compared in blocks of about BLOCK members, dealt by
    hash: only blocks with members outside the bucket's largest group meet the other blocks, inside tasks, and only links come
    out. Frequent buckets get their pivot and their numbers of blocks by broadcast.
    """
    entries = representatives.select(F.col(ROW).alias("doc"), F.explode("buckets").alias("bucket"))
    spans = entries.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.max("doc").alias("top"), F.count(F.lit(1)).alias("members"))
    first = staged(spans.filter("pivot < top").drop("top"), "pivots")
    n_entries = first.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    live = staged(join_groups(entries, first, ["bucket"], "members", n_entries).filter("doc > pivot"), "live")
    pairs = staged(live.select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct(), "pairs")
    known = staged(verify(pairs, texts).filter(F.col("sim") >= threshold - 1e-12), "verified")
    roots = components(known)
    nodes = live.select(F.col("doc").alias("node")).unionByName(live.select(F.col("pivot").alias("node"))).distinct()
    labels = staged(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "groups")

    # pivots have met all members of their bucket; the others are compared if they are in several groups
    rooted = staged(live.select("bucket", "doc").join(labels.withColumnRenamed("node", "doc"), "doc"), "rooted")
    sizes = staged(rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    largest = F.max(F.struct("n", "root"))
    open_ = sizes.groupBy("bucket").agg(F.sum("n").alias("members"), largest.alias("top")).filter("top.n < members")
    buckets = staged(open_.select("bucket", "members", F.col("top.n").alias("largest"), F.col("top.root").alias("main")), "open")
    # up to BLOCK members are one block. Else blocks 0 to n_open - 1 hold members outside the largest group; they meet each other
    # and all blocks of that group
    few = F.col("members") <= BLOCK
    n_open = F.when(few, 1).otherwise(F.ceil((F.col("members") - F.col("largest")) / BLOCK)).cast("int")
    n_main = F.when(few, 0).otherwise(F.ceil(F.col("largest") / BLOCK)).cast("int")
    hashed = F.xxhash64("doc", "bucket")
    block = F.when(~few & (F.col("root") == F.col("main")), n_open + F.pmod(hashed, n_main)).otherwise(F.pmod(hashed, n_open)).cast("int")
    blocked = join_groups(rooted, buckets, ["bucket"], "members", n_entries).withColumn("block", block)
    partner = F.sequence(F.lit(0), n_open + n_main - 1)
    meets = F.transform(partner, lambda o: F.when(F.least(o, F.col("block")) < n_open, F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"))))
    placed = staged(blocked.select("bucket", "doc", "root", "block", F.inline(F.array_compact(meets))), "blocks")
    wanted = placed.select(F.col("doc").alias(ROW)).distinct()
    sets = staged(shingle_sets(texts.join(wanted, ROW, "left_semi")), "sets")

    def compare(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = table.filter(pa.array(block == i)), None if i == j else table.filter(pa.array(block == j))
        found = block_links(left, right, threshold) if left.num_rows else []
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    linked = placed.join(sets, "doc").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")
    return relabel(labels, staged(linked.distinct(), "links"))


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the groups that (a, b) links join have become one."""
    of_a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    of_b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = links.join(of_a, "a").join(of_b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    moved = components(between).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return labels.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))


def stars(links: DataFrame, every: bool) -> DataFrame:
    """(node, root): each node of a partition's (a, b) links with the smallest node it is joined to by them; roots only if `every`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        nodes, at = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
        a, b = at[: table.num_rows], at[table.num_rows :]
        root = np.arange(len(nodes))
        while (root[a] != root[b]).any():
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        shown = np.ones(len(nodes), bool) if every else root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[shown]), pa.array(nodes[root[shown]])], ["node", "root"])

    return links.select("a", "b").mapInArrow(run, "node long, root long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of (a, b) links with the smallest node of its component.

    Links are first reduced to stars inside their partitions. What is left is joined up in one task if it is at most ONE_TASK
    links (32 MB), else by rounds of taking neighbours' labels and jumping to the labels' labels.
    """
    reduced = staged(stars(links, False).select(F.col("node").alias("a"), F.col("root").alias("b")), "stars")
    if reduced.count() <= ONE_TASK:
        return stars(reduced.coalesce(1), True)
    edges = staged(reduced.unionByName(reduced.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", "root", F.least("root", "m").alias("lower"))
        # then jump: a root's own label is at least as small
        roots = labels.select(F.col("node").alias("_r"), F.col("root").alias("_far"))
        nexts = staged(lower.join(roots, lower["lower"] == roots["_r"], "left").select("node", "root", F.least("lower", F.coalesce("_far", "lower")).alias("next")), "labels")
        changed = not nexts.filter("next < root").isEmpty()
        labels = nexts.select("node", F.col("next").alias("root"))
        if not changed:
            return labels


def _judged(base: DataFrame, threshold: float, bands: int, registers: int, text: str, doc_id: str) -> DataFrame:
    """(_row, class_id, group_id, kept) for each row of the scratch table `base`."""
    texts = base.select(ROW, F.col("_d").getField(text).alias("text"))
    signed = staged(signatures(texts, bands, registers), "signatures")
    of_row = F.col("_d").getField(doc_id).cast("long")
    order = base.select(ROW, F.struct(of_row.isNull().alias("none"), of_row.alias("id"), "_tie", F.col(ROW).alias("row")).alias("_o"))
    known = staged(signed.select(ROW, "class_hi", "class_lo").join(order, ROW), "near-known")
    classes = staged(known.groupBy("class_hi", "class_lo").agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("size")), "near-classes")
    heads = classes.select(F.col("_first.row").alias(ROW))
    roots = near_links(signed.join(heads, ROW, "left_semi").select(ROW, "buckets"), texts, threshold)
    # a class that shares no bucket is a group of its own
    rooted = classes.join(roots, F.col("_first.row") == F.col("node"), "left").withColumn("root", F.coalesce("root", "_first.row")).drop("node")
    rooted = staged(rooted, "near-rooted")
    groups = staged(rooted.groupBy("root").agg(F.min("_first").alias("_group"), F.count(F.lit(1)).alias("n_classes")), "near-groups")
    named = join_groups(rooted, groups, ["root"], "n_classes", rooted.count())
    named = staged(named.select("class_hi", "class_lo", "size", F.col("_first.id").alias("class_id"), F.col("_group.id").alias("group_id"), F.col("_group.row").alias("_keeper")), "near-named")
    joined = join_groups(known, named, ["class_hi", "class_lo"], "size", known.count())
    return joined.select(ROW, "class_id", "group_id", (F.col(ROW) == F.col("_keeper")).alias("kept"))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id with the same words), group_id (smallest doc_id of all that
    are linked), kept (true for exactly one row of each group)."""
    base = numbered(packed(docs.select(doc_id, text)), "near-rows")
    judged = _judged(base, threshold, bands, rows, text, doc_id)
    ids = base.select(ROW, F.col("_d").getField(doc_id).cast("long").alias("doc_id"))
    return ids.join(judged, ROW).select("doc_id", "class_id", "group_id", "kept")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, one of each group."""
    base = numbered(packed(docs), "near-rows")
    judged = _judged(base, threshold, bands, rows, text, doc_id)
    return unpacked(base.join(judged.filter("kept").select(ROW), ROW, "left_semi"), docs)
