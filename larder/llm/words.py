"""Word and shingle hashes of Arrow text columns, computed over whole buffers with numpy.

A word is a run of bytes outside space and 9 to 13; those bytes never occur inside other UTF-8 characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once, about; memory is some 40 times that.
CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


@dataclass
class Words:
    """Words of consecutive texts: text k has words first[k] to first[k + 1]; byte positions are in `data`."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(column: pa.Array) -> Words:
    """Nulls have no words."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    n = len(data)
    if not n:
        return Words(data, at, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64), np.zeros(0, np.uint64))
    space = _SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = at[(at > 0) & (at < n)]
    before[inner] = True
    after[inner - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(data, at, start, end, np.searchsorted(start, at), hashes)


def gram_hashes(words: Words, k: int) -> np.ndarray:
    """Hash of the k words from each word on; only those that stay in their text mean anything."""
    n = len(words.hash)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        out[: n - j] = out[: n - j] * np.uint64(BASE) + words.hash[j:]
    return mixed(out)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `limit` bytes of text; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    a, total = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > a and total + n > limit:
            yield batch.slice(a, k - a)
            a, total = k, 0
        total += n
    if a < batch.num_rows:
        yield batch.slice(a)
