"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes.

Both vocabularies encode a text; every token ends at a byte. Where a token of A and one of B end together the text can be cut.
The cuts are found by divide and conquer: an interval looks for a common end near its middle by bisecting each side's ends
in turn, is split there, and both halves go on; an interval in which no common end is found is a group. All intervals of a
chunk of texts take their steps together, as arrays.

Since both ids of a link end at one byte of one text, the bytes of one are a suffix of the other's. So the number of different
linked pairs is bounded by the two vocabularies (`pair_bound`), whatever the corpus: pair counts are summed per task and then by
pair, and the table of at most that many rows is sent to all tasks. Links lie packed in a scratch table between the two passes;
texts are read and encoded once and never shuffled. The largest unit of work is one text.

Defined cases: a null or empty text, and one whose joined tokens don't give its bytes back, has no tokens. Special strings inside
texts are plain text. A very long text is aligned whole, in a chunk of its own. Repeated rows are texts of their own and count
each. An empty table gives an empty result. Other columns than `keep` are ignored; names inside the operator can't clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.bpe import PATTERN, vocabulary
from larder.llm.common import staged
from larder.llm.words import chunks

#: Texts that need the first library: it and tiktoken might disagree on what a letter is in other scripts, and long runs are slow.
UNUSUAL = re.compile(r"[^\x00-\u024f]|\S{1000}|\s{1000}").search
ALIGNED = "n_a long, n_b long, n_groups long, groups string, links binary"


def byte_level_tokens(file: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; an added token stands for its own text."""
    of = vocabulary(file).bytes_of
    return [of.get(i, b"") for i in range(max(of) + 1)]


def fast_encoder(file: str):
    """A function from a text to its ids by tiktoken, or None where the file isn't plain byte-level BPE whose ids follow its merges."""
    import tiktoken

    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    cut, v = spec["pre_tokenizer"] or {}, vocabulary(file)
    made = [v.ids[v.bytes_of[x] + v.bytes_of[y]] for x, y in v.rank]  # in the order of the merges
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec["normalizer"] and not spec["model"].get("ignore_merges")
    if not plain or made != sorted(set(made)):
        return None
    coding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ids | {bytes([b]): v.ids[bytes([b])] for b in range(256)}, special_tokens={})
    return lambda text: coding.encode_to_numpy(text, disallowed_special=())


def piece_tokens(file: str) -> list[bytes]:
    """Bytes of each id of a piece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    of = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return [of(i) for i in range(model.get_piece_size())]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs can be linked at all: one's bytes end with the other's."""
    in_a, in_b = Counter(a), Counter(b)
    longer_a = sum(in_b[t[k:]] for t in a for k in range(len(t)))
    return longer_a + sum(in_a[t[k:]] for t in b for k in range(1, len(t)))


def shared_ends(a_end: np.ndarray, b_end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (in A, in B) of tokens that end together; both ends grow strictly, and A's ranges lo to hi end at shared ends.

    A search holds the range [left, right) of A's tokens that may end a cut, and goes on from `at`. One step bisects B's ends for A's
    end, and A's ends for the B end found: either they meet, and the range falls in two, or `at` moves on. Beyond the right side
    there is no cut from the middle on, and the search goes on in the left half.
    """
    last = hi[hi > lo] - 1
    found_a, found_b = [last], [np.searchsorted(b_end, a_end[last])]
    left, right = lo[hi > lo], last
    middle = (left + right) >> 1
    at = middle.copy()
    while True:
        live = left < right
        if not live.all():
            left, right, middle, at = left[live], right[live], middle[live], at[live]
        if not len(left):
            return np.concatenate(found_a), np.concatenate(found_b)
        end = a_end[at]
        j = np.searchsorted(b_end, end)
        meet = b_end[j] == end
        found_a.append(at[meet])
        found_b.append(j[meet])
        on = ~meet
        next_at = np.searchsorted(a_end, b_end[j[on]])
        out = next_at >= right[on]
        # the halves of the split ones: before the middle (nothing lies between it and the cut), and behind the cut
        l_left, l_right, r_left, r_right = left[meet], middle[meet], at[meet] + 1, right[meet]
        o_left, o_right, o_middle = left[on], np.where(out, middle[on], right[on]), middle[on]
        o_middle = np.where(out, (o_left + o_right) >> 1, o_middle)
        o_at = np.where(out, o_middle, next_at)
        left, right = np.concatenate([l_left, r_left, o_left]), np.concatenate([l_right, r_right, o_right])
        l_middle, r_middle = (l_left + l_right) >> 1, (r_left + r_right) >> 1
        middle, at = np.concatenate([l_middle, r_middle, o_middle]), np.concatenate([l_middle, r_middle, o_at])


@dataclass
class Side:
    """One vocabulary in a task: how to encode, its tokens' bytes in a row and where each begins, and decimal ids with each separator."""

    encode: object
    raw: np.ndarray
    at: np.ndarray
    shown: np.ndarray

    @classmethod
    def of(cls, encode, token: list[bytes], ends: str) -> Side:
        shown = np.array([f"{i}{s}" for i in range(len(token)) for s in (",", ends)], object)
        return cls(encode, np.frombuffer(b"".join(token), np.uint8), np.cumsum([0, *map(len, token)]), shown)

    def length(self, ids: np.ndarray) -> np.ndarray:
        return self.at[ids + 1] - self.at[ids]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length(ids)
        return self.raw[np.arange(n.sum()) + np.repeat(self.at[ids] - (np.cumsum(n) - n), n)]


@lru_cache(1)
def sides(file_a: str, file_b: str) -> tuple[Side, Side]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(file_a)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    many, fast = getattr(a, "encode_batch_fast", a.encode_batch), fast_encoder(file_a)
    b = sentencepiece.SentencePieceProcessor(model_file=file_b)

    def encode_a(texts: list[str]) -> list:
        out = [fast(" " + t) if fast and not UNUSUAL(t) else None for t in texts]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, many([" " + texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    return Side.of(encode_a, byte_level_tokens(file_a), "|"), Side.of(lambda texts: b.encode(texts, num_threads=1), piece_tokens(file_b), ";")


def _starts(sizes) -> np.ndarray:
    return np.append(0, np.cumsum(np.fromiter(sizes, np.int64)))


def _flat(ids: list, at: np.ndarray) -> np.ndarray:
    """All ids in one array."""
    flat = np.empty(at[-1], np.int64)
    for k, x in enumerate(ids):
        flat[at[k] : at[k + 1]] = x
    return flat


def given_back(ids: list, wanted: list[bytes], side: Side) -> np.ndarray:
    """Which texts the joined tokens give back, byte by byte."""
    at = _starts(map(len, ids))
    flat = _flat(ids, at)
    size = np.append(0, np.cumsum(side.length(flat)))[at]
    fits = np.diff(size) == np.fromiter(map(len, wanted), np.int64, len(wanted))
    flat = flat[np.repeat(fits, np.diff(at))]
    odd = side.bytes_of(flat) != np.frombuffer(b"".join(w for w, f in zip(wanted, fits, strict=True) if f), np.uint8)
    ends = _starts(n for n, f in zip(np.diff(size), fits, strict=True) if f)
    fits[fits] = np.diff(np.append(0, np.cumsum(odd))[ends]) == 0
    return fits


def align_texts(texts: list[str | None], a: Side, b: Side, show=None) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, groups, links) of each text; `show` makes what goes to `groups` from the text of the groups."""
    some = [k for k, t in enumerate(texts) if t]
    ids_a, ids_b = a.encode([texts[k] for k in some]), b.encode([texts[k] for k in some])
    wanted = [b" " + texts[k].encode() for k in some]
    true = np.flatnonzero(given_back(ids_a, wanted, a) & given_back(ids_b, wanted, b)).tolist()
    ids_a, ids_b = [ids_a[n] for n in true], [ids_b[n] for n in true]
    at_a, at_b = _starts(map(len, ids_a)), _starts(map(len, ids_b))
    flat_a, flat_b = _flat(ids_a, at_a), _flat(ids_b, at_b)
    cut_a, cut_b = shared_ends(np.cumsum(a.length(flat_a)), np.cumsum(b.length(flat_b)), at_a[:-1], at_a[1:])
    cut_a.sort()
    cut_b.sort()
    ends_a, ends_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
    ends_a[cut_a] = ends_b[cut_b] = 1
    links = ((flat_a[cut_a] << 16) | flat_b[cut_b]).astype(np.uint32)
    first = np.searchsorted(cut_a, at_a)
    if show is not None:  # tokens in the order of the groups, A's before B's; a token stands behind the other side's that come before
        line = np.empty(len(flat_a) + len(flat_b), object)
        groups_a, groups_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        line[np.arange(len(flat_a)) + np.append(0, cut_b + 1)[groups_a]] = a.shown[2 * flat_a + ends_a]
        line[np.arange(len(flat_b)) + cut_a[groups_b] + 1] = b.shown[2 * flat_b + ends_b]
    at = dict(zip([some[n] for n in true], range(len(true)), strict=True))
    for k in range(len(texts)):
        if (n := at.get(k)) is None:
            yield 0, 0, 0, "", b""
        else:
            groups = None if show is None else show("".join(line[at_a[n] + at_b[n] : at_a[n + 1] + at_b[n + 1]].tolist())[:-1])
            yield int(at_a[n + 1] - at_a[n]), int(at_b[n + 1] - at_b[n]), int(first[n + 1] - first[n]), groups, links[first[n] : first[n + 1]].tobytes()


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def align(docs: DataFrame, file_a: str, file_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), groups: str = "text") -> DataFrame:
    """`_d` (a struct of `keep`), n_a, n_b, n_groups, groups and links of each row.

    groups: `text` (`a1,a2|b1;a3|b2,b3`), `sha256` of that text, or `none`. links: a packed 32-bit number per link, A's id times
    65536 plus B's. A byte-level vocabulary (.json) is A, a piece vocabulary (.model) is B.
    """
    if len(byte_level_tokens(file_a)) > 1 << 16 or len(piece_tokens(file_b)) > 1 << 16:
        raise ValueError("links are packed for vocabularies of at most 65,536 ids")
    show = {"text": str, "sha256": _sha256, "none": None}[groups]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_d"), F.col(f"`{text}`").alias("_t"))
    schema = T.StructType([rows.schema["_d"], *T._parse_datatype_string(ALIGNED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(file_a, file_b)
        for batch in batches:
            for part in chunks(batch, "_t"):
                found = list(align_texts(part.column("_t").to_pylist(), a, b, show))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                out = [pa.array(column, kind) for column, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_d"), *out], ["_d", "n_a", "n_b", "n_groups", "groups", "links"])

    return rows.mapInArrow(run, schema)


def _links(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch, and where each row's begin."""
    column = part.column("links").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    flat = np.frombuffer(raw, np.uint8)[at[0] : at[-1]].view(np.uint32) if raw is not None else np.zeros(0, np.uint32)
    return flat, (at - at[0]) >> 2


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links that hold each pair of ids, and whether no other A id is linked more often with its B id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for part in chunks(batch, "links", 4 << 20):
                more, times = np.unique(_links(part)[0], return_counts=True)
                pairs, back = np.unique(np.concatenate([pairs, more]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n, times]), len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], ["pair", "n"])

    counts = aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair") % 65536)
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_b))


def count_links(aligned: DataFrame, bound: int) -> DataFrame:
    """`aligned` (a scratch table) without its links, with n_links, n_best and count_sum. At most `bound` pairs are sent to the tasks."""
    spark = aligned.sparkSession
    counts = count_pairs(aligned).limit(bound + 1).toArrow()  # one more than there can be, so that a wrong bound shows
    if counts.num_rows > bound:
        raise ValueError(f"more than {bound} pairs of ids")
    pair = counts.column("pair").to_numpy()
    order = np.argsort(pair)
    table = spark.sparkContext.broadcast(tuple(x[order] for x in (pair.astype(np.uint32), counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False).astype(np.int64))))
    fields = [f for f in aligned.schema.fields if f.name != "links"]
    schema = T.StructType([*fields, *T._parse_datatype_string("n_links long, n_best long, count_sum long").fields])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        for batch in batches:
            for part in chunks(batch, "links", 4 << 20):
                flat, at = _links(part)
                k = np.searchsorted(pairs, flat)
                sums = [np.append(0, np.cumsum(x[k]))[at] for x in (best, n)]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], *[pa.array(np.diff(x)) for x in (at, *sums)]], [f.name for f in schema.fields])

    return aligned.mapInArrow(look_up, schema)


def align_counted(docs: DataFrame, file_a: str, file_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), groups: str = "text") -> DataFrame:
    """`keep`, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each row of `docs`."""
    aligned = staged(align(docs, file_a, file_b, text, keep, groups), "aligned")
    counted = count_links(aligned, pair_bound(byte_level_tokens(file_a), piece_tokens(file_b)))
    return counted.select("_d.*", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
