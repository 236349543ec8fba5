"""A compressed FM-index over integer symbols: Burrows-Wheeler transform in a wavelet matrix of packed bits.

Many patterns are searched at once: every step extends all live patterns by one symbol to the left, as array operations.
"""

from __future__ import annotations

import numpy as np

WORD = 64
#: Positions whose owners have a common minimum.
BLOCK = 16


class BitVector:
    """Packed bits with a count of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // WORD + 1) * WORD, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.levels.append(BitVector(bits.astype(np.uint8)))
            self.zeros.append(len(bits) - int(bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of each symbol's occurrences falls in the last level."""
        top = len(self.levels) - 1
        for k, (vector, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = vector.rank(i)
            i = np.where((symbol >> (top - k)) & 1, zeros + ones, i - ones)
        return i


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes. Every 0 is a separator smaller than all else, and they differ by place.

    Prefix doubling in which only suffixes that are not yet told apart are sorted again; a rank is the first place of its group.
    """
    n = len(symbols)
    separator = symbols == 0
    n_sep = int(separator.sum())
    first = np.where(separator, np.cumsum(separator) - 1, symbols.astype(np.int64) + n_sep)
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    alone = new & np.append(new[1:], True)
    at = np.flatnonzero(~alone)  # places in the order whose suffixes share their rank
    step = 1
    while len(at) and step < n:
        suffix = order[at]
        group = start[at]
        after = np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)] + 1, 0)
        # places of a group are neighbours, so sorting by group keeps them in place
        inner = np.lexsort((after, group))
        suffix, group, after = suffix[inner], group[inner], after[inner]
        order[at] = suffix
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        begin = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        start[at] = begin
        rank[suffix] = begin
        at = at[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class FMIndex:
    """Index over sequences of symbols >= 1 that are separated (and ended) by 0, each position with an owner.

    A search asks for occurrences whose owner is below a limit; for that the index keeps minima of the owners: five
    numbers per position and a table over blocks of BLOCK positions.
    """

    def __init__(self, symbols: np.ndarray, owner: np.ndarray):
        self.n = len(symbols)
        order = suffix_array(symbols)
        levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.matrix = WaveletMatrix(symbols[order - 1], levels)  # the symbol before each suffix; before the first is the last, a 0
        every = np.arange(1 << levels)
        counts = np.bincount(symbols, minlength=1 << levels)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.shift = first - self.matrix.place(every, np.zeros(1 << levels, np.int64))
        # minima of 1, 2, 4 ... BLOCK owners from each position on, and a sparse table over whole blocks
        self.near = [owner[order]]
        while 1 << (len(self.near) - 1) < BLOCK:
            last, width = self.near[-1], 1 << (len(self.near) - 1)
            self.near.append(np.append(np.minimum(last[:-width], last[width:]), last[-width:]) if self.n > width else last)
        self.far = [self.near[-1][::BLOCK][: self.n // BLOCK]]
        width = 1
        while 2 * width <= len(self.far[0]):
            last = self.far[-1]
            self.far.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that begin with symbol and go on as those from low to high."""
        both = self.matrix.place(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        k = len(symbol)
        return both[:k] + self.shift[symbol], both[k:] + self.shift[symbol]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest owner from low to high, which must not be empty."""
        level = np.minimum(np.frexp((high - low).astype(np.float64))[1] - 1, len(self.near) - 1)
        out = np.empty(len(low), self.near[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.near[k][low[at]], self.near[k][high[at] - (1 << int(k))])
        wide = np.flatnonzero(high - low > 2 * BLOCK)
        if len(wide):
            begin, end = -(-low[wide] // BLOCK), high[wide] // BLOCK
            level = np.frexp((end - begin).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = level == k
                table = self.far[k]
                out[wide[at]] = np.minimum(out[wide[at]], np.minimum(table[begin[at]], table[end[at] - (1 << int(k))]))
        return out

    def match_back(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For each stream part symbols[begin:end], the start of its longest suffix that occurs with an owner below limit.

        This is the matching statistic of the part's last position, cut at begin.
        """
        start = end.copy()
        live = np.flatnonzero(end > begin)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        while len(live):
            low, high = self.extend(symbols[start[live] - 1], low, high)
            ok = np.flatnonzero(high > low)
            ok = ok[self.least_owner(low[ok], high[ok]) < limit[live[ok]]]
            live, low, high = live[ok], low[ok], high[ok]
            start[live] -= 1
            more = start[live] > begin[live]
            live, low, high = live[more], low[more], high[more]
        return start


def covered_by_earlier(index: FMIndex, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: np.ndarray, window: int) -> np.ndarray:
    """Marks the symbols of each stream part that lie in a window which occurs with an owner below the part's limit.

    From a window that fails, every window up to the failing position fails too, so the next one starts behind it. From
    one that matches, the part tried grows.
    """
    change = np.zeros(len(symbols) + 1, np.int32)
    lane = np.flatnonzero(end - begin >= window)
    s, extra = begin[lane].copy(), np.zeros(len(lane), np.int64)
    while len(lane):
        e = np.minimum(s + window + extra, end[lane])
        at = index.match_back(symbols, s, e, limit[lane])
        hit = at == s
        np.add.at(change, s[hit], 1)
        np.add.at(change, e[hit], -1)
        grown = e - s > window
        s = np.where(hit, e - window + 1, np.where(grown, s, at))
        extra = np.where(hit, 2 * extra + 1, 0)
        on = s + window <= end[lane]
        lane, s, extra = lane[on], s[on], extra[on]
    return np.cumsum(change[:-1]) > 0
