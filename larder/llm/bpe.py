"""BPE encoding by per-prefix dynamic programming, and decoding.

A text is cut as the tokenizer cuts it: at special strings, then by the vocabulary's pattern. Within a piece, an
automaton over all tokens reports for every prefix the tokens that end there; the last token of the exact encoding is
the one that is compatible with the last token of the prefix before it, and it is unique. Two tokens are compatible if
the merges would never join across their border. Following the last tokens back gives the ids that merging would give,
in time linear in the piece, whatever its length.

Pieces repeat, so each Python worker keeps the ids of up to twice `CACHED_PIECES` pieces, in two generations (a speed-up
only). Both directions are narrow: no shuffle, and memory bounded by a batch.

Defined cases: null text is empty and has no ids. Special strings inside texts become their ids, as the library does by
default; nothing is added, truncated or padded. A very long text is encoded whole; it must fit a row. Repeated rows, repeated or null
doc_ids and empty tables pass through. A column of the input named
like the output column is replaced.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larder.llm.words import chunks

CACHED_PIECES = 60_000
CACHED_PAIRS = 200_000
LONG_PIECE = 256
#: How the byte-level vocabulary cuts a text before its merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for texts within U+0000 to U+024F, whose letters and numbers can be listed.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file, inverted."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a byte-level BPE file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_of_char()
        model = spec["model"]
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank of its merge
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = ids[as_bytes(left)], ids[as_bytes(right)]
            self.rank.setdefault((a, b), rank)
            self.parts.setdefault(ids[as_bytes(left) + as_bytes(right)], (a, b, rank))
        self.ids = ids

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for token, i in self.ids.items():
            machine.add_word(token.decode("latin-1"), i)
        machine.make_automaton()
        return machine

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives these two tokens.

        Undo the merges on both sides of the border, latest first. A merge across the border spoils the pair if it comes
        before the merge that used up either neighbour; of equal ranks the one further left is done first.
        """
        rank, parts = self.rank, self.parts
        until = 1 << 60  # only a border merge of smaller rank happens while both neighbours exist
        while True:
            if rank.get((a, b), until) < until:
                return False
            left, right = parts.get(a), parts.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[2] > right[2]:
                a, until = left[1], left[2]
            else:
                b, until = right[0], right[2] + 1


class Encoder:
    def __init__(self, file: str):
        import regex

        self.vocabulary = vocabulary(file)
        self.machine = self.vocabulary.automaton()
        self.size = [len(self.vocabulary.bytes_of.get(i, b"")) for i in range(max(self.vocabulary.bytes_of) + 1)]
        self.wide = regex.compile(PATTERN).findall
        self.latin = re.compile(LATIN_PATTERN).findall
        self.outside_latin = re.compile("[^\x00-\u024f]").search
        special = self.vocabulary.special
        # the longest special string first where two begin alike
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def pieces(self, text: str) -> list[str]:
        return self.wide(text) if self.outside_latin(text) else self.latin(text)

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8").decode("latin-1")
        size, pairs, known = self.size, self.pairs, self.pairs.get
        last = [-1] * len(raw)  # by the prefix's last byte
        # longest first for each end; every prefix gets a last token, since all bytes are tokens
        for end, token in self.machine.iter(raw):
            if last[end] < 0:
                before = end - size[token]
                if before >= 0:
                    pair = last[before] << 20 | token
                    fits = known(pair)
                    if fits is None:
                        fits = pairs[pair] = self.vocabulary.compatible(last[before], token)
                    if fits:
                        last[end] = token
                else:
                    last[end] = token
        ids, at = [], len(raw) - 1
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= size[token]
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def encode_bytes(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        if self.special is None:
            return self._plain(text)
        special = self.vocabulary.special
        return b"".join([np.int32(special[part]).tobytes() if k % 2 else self._plain(part) for k, part in enumerate(self.special.split(text))])

    def _plain(self, text: str) -> bytes:
        known, miss = self.cache.get, self._miss
        out = b"".join([known(p) or miss(p) for p in self.pieces(text)])
        if len(self.cache) > CACHED_PIECES:
            # what was used lately stays for one more generation
            self.older, self.cache = self.cache, {}
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
        return out

    def _miss(self, piece: str) -> bytes:
        got = self.older.get(piece) or array("i", self.piece(piece)).tobytes()
        if len(piece) <= LONG_PIECE:
            self.cache[piece] = got
        return got


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(file: str) -> Vocabulary:
    if file not in _VOCABULARIES:
        _VOCABULARIES[file] = Vocabulary(file)
    return _VOCABULARIES[file]


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder per Python worker and file."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def _columns(df: DataFrame, drop: set[str]) -> list[str]:
    return [c for c in df.columns if c not in drop]


def bpe_encode(docs: DataFrame, file: str, text: str = "text", output: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its `keep` columns) with the exact ids of the text, array<int>."""
    kept = _columns(docs.select(*keep) if keep is not None else docs, {output})
    source = docs.select(*kept, docs[text].alias("_text"))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(output, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file).encode_bytes
        for whole in batches:
            for b in chunks(whole, "_text"):
                ids = [encode(t or "") for t in b.column("_text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), lists], [*kept, output])

    return source.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, file: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """`encoded` with the text of its ids; bytes that are no UTF-8 become U+FFFD. Null ids give empty text."""
    kept = _columns(encoded, {output})
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(file).bytes_of
        table = [known.get(i, b"") for i in range(max(known) + 1)]
        for b in batches:
            column = b.column(ids)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
            texts = [b"".join(map(table.__getitem__, flat[i:j].tolist())).decode("utf-8", "replace") for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, output])

    return encoded.mapInArrow(run, schema)
