"""Substring dedup with a compressed FM-index per shard.

A word is removed if a window of `window` words that covers it also starts in a document of smaller doc_id. Windows are
dealt to shards by content: a window's anchor is the least of its grams of `GRAM` words, so equal windows meet in one shard and
windows that follow each other mostly share an anchor and travel as one segment. In each shard the distinct segments are indexed
(FM-index over words, backward search in a wavelet matrix) and streamed against that index; matching statistics restricted to
smaller doc_ids give the intervals of at least `window` words.

Only segments whose anchor occurs in two documents are looked at. Each gets a 128-bit digest first, and digests are grouped: equal
segments need no index, and where all segments of an anchor are equal, that decides them. Only where an anchor has different
segments do words travel, each distinct segment once, from the smallest document that has it. So copies cost a digest, and a passage that
many documents share is indexed once; places find their group's result by a join in which large groups are broadcast. The borders of a
shared passage, different in each document, would still meet at the passage's anchors; anchors that are frequent in a hash sample of documents therefore come last in the order, and
windows with any other gram avoid them (at most `MAX_HOT` anchors, which all tasks get). The choice of anchors changes
only who meets where, not the result. What is left to a frequent anchor are windows of frequent grams only; equal ones are one
segment there, however many documents hold them. An anchor that is not among the frequent ones has at most some 1 / MAX_HOT of all
anchors, so a shard's index grows with the input only where different texts share a gram of 12 words that often.

Defined cases: null text has no words. A text of fewer than `window` words stays whole, a very long one is cut into segments like any
other and must fit a row. Repeats within one document
don't count. doc_id names a document: identical rows that repeat it get identical results, and rows that
give it to different texts share the intervals of either. Null doc_id: the row keeps all its words and removes
none elsewhere. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import join_groups, staged
from larder.llm.fmindex import FMIndex, covered_by_earlier
from larder.llm.words import Words, chunks, gram_hashes, mixed, words_of

WINDOW, GRAM = 50, 12
#: Windows of a segment at most; a repetitive text would otherwise be one segment.
SEGMENT_WINDOWS = 64
MAX_HOT = 20_000
#: One of so many documents is in the sample for frequent anchors.
SAMPLE = 16
SHARD_WORDS = 250_000


def segments(words: Words, hot: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of windows, anchor) of all segments; words are counted over the whole chunk."""
    n = len(words.hash)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty
    grams = gram_hashes(words, gram)
    order = mixed(grams + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        order[hot[at] == grams] |= np.uint64(1 << 63)
    width = window - gram + 1
    least, done = order, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    text = words.texts()
    start = np.arange(n - window + 1)
    least = least[: len(start)]
    inside = text[start] == text[start + window - 1]
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[start][1:] != text[start][:-1])
    run = np.maximum.accumulate(np.where(new, start, 0))
    new |= (start - run) % SEGMENT_WINDOWS == 0
    new[1:] |= inside[1:] != inside[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(start)))
    ok = inside[at]
    return text[at][ok], at[ok], count[ok], least[at][ok].view(np.int64)


def anchors(docs: DataFrame, hot: np.ndarray, window: int, gram: int) -> DataFrame:
    """(doc_id, anchor), once per document and anchor (and chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                text, _, _, anchor = segments(words_of(b.column("text")), hot, window, gram)
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(text[new])), pa.array(anchor[new])], ["doc_id", "anchor"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, anchor long")


def hot_anchors(docs: DataFrame, window: int, gram: int) -> np.ndarray:
    """Sorted gram hashes whose anchors are frequent in the sample."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                words = words_of(b.column("text"))
                text, start, count, anchor = segments(words, np.zeros(0, np.uint64), window, gram)
                order = mixed(gram_hashes(words, gram) + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1)
                _, at = np.unique(np.stack([text, anchor]), axis=1, return_index=True) if len(text) else (None, np.zeros(0, np.int64))
                # back from the order value to the gram: it is the least in the segment's first window
                found = []
                for k in at:
                    own = order[start[k] : start[k] + window - gram + 1]
                    found.append(start[k] + int(np.argmin(own)))
                yield pa.RecordBatch.from_arrays([pa.array(gram_hashes(words, gram)[found].view(np.int64))], ["gram"])

    counts = sample.mapInArrow(grams, "gram long").groupBy("gram").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(64, total // MAX_HOT)
    found = [r["gram"] for r in counts.filter(F.col("count") > least).select("gram").collect()]  # at most MAX_HOT
    return np.sort(np.array(found, np.int64).view(np.uint64))


def routed_segments(flagged: DataFrame, hot: np.ndarray, window: int, gram: int, n_shards: int, with_words: bool) -> DataFrame:
    """Segments of documents at their repeated anchors. With words: (shard, key, doc_id, words), a key again only for a
    smaller doc_id. Without: (key, anchor, doc_id, start, length)."""
    schema = "shard int, key binary, doc_id long, words string" if with_words else "key binary, anchor long, doc_id long, start int, length int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for whole in batches:
            for b in chunks(whole, "text"):
                words = words_of(b.column("text"))
                text, start, count, anchor = segments(words, hot, window, gram)
                ids, lists = b.column("doc_id").to_pylist(), b.column("anchors")
                owners = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                values = lists.flatten().to_numpy(zero_copy_only=False)
                # membership of (text, anchor) in the flagged lists
                mine = mixed(anchor.view(np.uint64) + mixed(text.astype(np.uint64)))
                ok = np.flatnonzero(np.isin(mine, mixed(values.astype(np.int64).view(np.uint64) + mixed(owners.astype(np.uint64)))))
                raw, a, z = words.data.tobytes(), words.start, words.end
                out: list[tuple] = []
                shards = (mixed(anchor.view(np.uint64)) % np.uint64(n_shards)).astype(np.int64)
                for t, s, n, shard, at in zip(text[ok].tolist(), start[ok].tolist(), count[ok].tolist(), shards[ok].tolist(), anchor[ok].tolist(), strict=True):
                    body = b" ".join(raw[a[s] : z[s + n + window - 2]].split())
                    key = hashlib.blake2b(body, digest_size=16).digest()
                    if not with_words:
                        out.append((key, at, ids[t], s - int(words.first[t]), n + window - 1))
                    elif seen.get(key, 1 << 63) > ids[t]:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen[key] = ids[t]
                        out.append((shard, key, ids[t], body))
                columns = list(zip(*out)) or [()] * 5
                if with_words:
                    arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, ["shard", "key", "doc_id", "words"])
                else:
                    arrays = [pa.array(c, kind) for c, kind in zip(columns, [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "anchor", "doc_id", "start", "length"])

    return flagged.select("doc_id", "text", "anchors").mapInArrow(run, schema)


def match_shard(table: pa.Table, window: int) -> pa.Table:
    """(key, found_doc, ranges) of a shard's segments: flat word ranges of each that also occur in a smaller doc_id."""
    least: dict[bytes, int] = {}
    bodies: dict[bytes, str] = {}
    for key, doc, words in zip(table.column("key").to_pylist(), table.column("doc_id").to_pylist(), table.column("words").to_pylist(), strict=True):
        if least.get(key, 1 << 63) > doc:
            least[key] = doc
        bodies[key] = words
    number: dict[str, int] = {}
    flat: list[int] = []
    ends = [0]
    for body in bodies.values():
        flat += [number.setdefault(w, len(number) + 1) for w in body.split(" ")]
        flat.append(0)
        ends.append(len(flat))
    symbols, ends_at = np.array(flat, np.int64), np.array(ends)
    owner = np.array([least[k] for k in bodies], np.int64)
    index = FMIndex(symbols, np.repeat(owner, np.diff(ends_at)))
    covered = covered_by_earlier(index, symbols, ends_at[:-1], ends_at[1:] - 1, owner, window)
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # separators are never covered
    of = np.searchsorted(ends_at, begins, side="right") - 1
    pairs = np.stack([begins - ends_at[of], stops - ends_at[of]], axis=1).reshape(-1)
    offsets = np.searchsorted(of, np.arange(len(bodies) + 1)) * 2
    ranges = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(pairs.astype(np.int32)))
    return pa.table([pa.array(list(bodies), pa.binary()), pa.array(owner), ranges], ["key", "found_doc", "ranges"])


def cut(column: pa.Array, spans: list[list[tuple[int, int]]]) -> tuple[list[int], list[int], list[bytes]]:
    """Words, removed words and kept words (joined by one space) of each text without its word spans."""
    words = words_of(column)
    raw = words.data.tobytes()
    n_words, n_removed, kept = [], [], []
    for k, gone in enumerate(spans):
        parts = raw[words.text_at[k] : words.text_at[k + 1]].split()
        keep = np.ones(len(parts), bool)
        for a, z in gone:
            keep[a:z] = False
        left = int(keep.sum())
        n_words.append(len(parts))
        n_removed.append(len(parts) - left)
        kept.append(b" ".join(parts if left == len(parts) else [p for p, x in zip(parts, keep.tolist(), strict=True) if x]))
    return n_words, n_removed, kept


def _finish(rows: DataFrame, spans: bool, digest_only: bool, carry: bool) -> DataFrame:
    """Results of (doc_id, text[, spans]); with `carry`, rows that have anchors keep their text and get no result yet."""
    schema = "doc_id long, n_words long, n_removed long, kept string" + (", text string, anchors array<bigint>" if carry else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                text = b.column("text")
                todo = [True] * b.num_rows
                if carry:
                    todo = b.column("anchors").is_null().to_pylist()
                gone = [[(x["start"], x["end"]) for x in s or ()] for s in b.column("spans").to_pylist()] if spans else [[]] * b.num_rows
                own = text if all(todo) else text.take(pa.array([k if x else None for k, x in enumerate(todo)], pa.int32()))
                n, removed, kept = cut(own, gone)
                out = [hashlib.sha256(x).hexdigest() if digest_only else x.decode() for x in kept]
                arrays = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([x if y else None for x, y in zip(out, todo, strict=True)], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept"]
                if carry:
                    arrays += [text.take(pa.array([None if x else k for k, x in enumerate(todo)], pa.int32())), b.column("anchors")]
                    names += ["text", "anchors"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest_only: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept per row of `docs`; kept is the remaining words joined by one space, or with
    `digest_only` its SHA-256."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ided = source.filter(F.col("doc_id").isNotNull())
    unnamed = _finish(source.filter(F.col("doc_id").isNull()), False, digest_only, False)
    hot = hot_anchors(ided, window, gram)
    found = anchors(ided, hot, window, gram)
    repeated = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("anchor")
    flags = found.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    first = staged(_finish(ided.join(flags, "doc_id", "left").select("doc_id", "text", "anchors"), False, digest_only, True), "flagged")
    flagged = first.filter(F.col("anchors").isNotNull())
    places = staged(routed_segments(flagged, hot, window, gram, 1, False), "places")
    keys = staged(places.groupBy("key").agg(F.first("anchor").alias("anchor"), F.min("doc_id").alias("least_doc"), F.count(F.lit(1)).alias("n_places")), "segment-keys")
    # anchors with different segments, and for each of those the smallest document that has it
    open_anchors = keys.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    sent = keys.join(open_anchors, "anchor", "left_semi").groupBy(F.col("least_doc").alias("doc_id")).agg(F.collect_set("anchor").alias("anchors"))
    sent = staged(sent, "sent-anchors")
    n_anchors = sent.agg(F.sum(F.size("anchors"))).first()[0] or 0
    n_shards = max(1, n_anchors * (window + SEGMENT_WINDOWS // 3) // SHARD_WORDS)
    bodies = routed_segments(flagged.select("doc_id", "text").join(sent, "doc_id"), hot, window, gram, n_shards, True)

    def run(table: pa.Table) -> pa.Table:
        return match_shard(table, window)

    matched = bodies.groupBy("shard").applyInArrow(run, "key binary, found_doc long, ranges array<int>").filter(F.size("ranges") > 0).select("key", "ranges")
    groups = staged(keys.select("key", "least_doc", "n_places").join(matched, "key", "left"), "segment-groups")
    joined = join_groups(places.select("key", "doc_id", "start", "length"), groups, ["key"], "n_places", places.count())
    own = F.transform(F.sequence(F.lit(0), F.size("ranges") - 1, F.lit(2)), lambda i: F.struct((F.col("start") + F.get("ranges", i)).alias("start"), (F.col("start") + F.get("ranges", i + 1)).alias("end")))
    span = F.when(F.col("doc_id") > F.col("least_doc"), F.array(F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("end")))).when(F.size("ranges") > 0, own)
    removed = joined.select("doc_id", span.alias("s")).filter(F.col("s").isNotNull()).groupBy("doc_id").agg(F.flatten(F.collect_list("s")).alias("spans"))
    rest = _finish(flagged.select("doc_id", "text").join(removed, "doc_id", "left"), True, digest_only, False)
    return first.filter(F.col("anchors").isNull()).select("doc_id", "n_words", "n_removed", "kept").unionByName(rest).unionByName(unnamed)
