"""A compressed FM-index over integer sequences: suffix order, BWT, wavelet matrix, backward search.

All operations are vectorised: many patterns are searched at once.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector, 64 to a word, with a count before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int64)
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _BELOW[at & 63])


#: For each bit of a word, the bits below it.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Rank of a symbol in front of a place, a bit vector for each bit of the symbols."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.rows: list[tuple[Bits, int]] = []
        for level in reversed(range(self.levels)):
            bit = (values >> level & 1).astype(bool)
            row = Bits(bit)
            self.rows.append((row, len(values) - row.ones))
            values = np.concatenate([values[~bit], values[bit]])

        self.begin = self._down(np.arange(size), np.zeros(size, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the places `at` (a row of symbols, or several) come to on the way of their symbol."""
        for level, (row, zeros) in zip(reversed(range(self.levels)), self.rows):
            ones = row.rank(at)
            at = np.where((symbol >> level & 1).astype(bool), ones + zeros, at - ones)
        return at

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of `symbol` stand in front of `low`, and of `high`."""
        low, high = self._down(symbol, np.stack([low, high])) - self.begin[symbol]
        return low, high


def suffix_order(values: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least (prefix doubling)."""
    n = len(values)
    rank = values.astype(np.int64)
    size, step = int(rank.max()) + 2, 1
    # As many symbols as a 64-bit number holds make up the first rank.
    while size ** (step + 1) < 1 << 62 and step < min(depth, n):
        shifted = np.zeros(n, dtype=np.int64)
        shifted[: n - step] = values[step:] + 1
        rank, step = rank * size + shifted, step + 1
    while True:
        order = np.argsort(rank)
        ranked = rank[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        top = int(new[order[-1]])
        if step >= depth or top == n - 1 or step >= n:
            return order
        follow = np.zeros(n, dtype=np.int64)
        follow[: n - step] = new[step:] + 1
        rank, step = new * (top + 2) + follow, step * 2


class FMIndex:
    """Over segments (arrays of word hashes), parted by a symbol that occurs in no pattern."""

    def __init__(self, segments: list[np.ndarray], depth: int):
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        joined = np.concatenate(segments)
        self.alphabet, coded = np.unique(joined, return_inverse=True)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.int64)  # 0 parts the segments
        places = np.arange(len(joined)) + np.repeat(np.arange(len(sizes)), sizes)
        text[places] = coded + 1
        self.text = text
        order = suffix_order(text, depth)
        self.tree = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])

    def reach(self, ends: np.ndarray, stops: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics by backward search in the index's own text.

        For each pattern that ends at `ends` (inclusive), extended to the left
        but not past `stops`: the leftmost start with which it occurs `least`
        times or more; ends + 1 where not even the last word does.
        """
        at = ends.copy()
        low, high = np.zeros_like(at), np.full_like(at, len(self.text))
        out = ends + 1
        live = np.arange(len(at))
        while len(live):
            word = self.text[at[live]]
            a, b = self.tree.ranks(word, low[live], high[live])
            a, b = a + self.below[word], b + self.below[word]
            good = b - a >= least
            live, low_, high_ = live[good], a[good], b[good]
            low[live], high[live] = low_, high_
            out[live] = at[live]
            at[live] -= 1
            live = live[at[live] >= stops[live]]
        return out


def repeated_windows(segments: list[np.ndarray], copies: np.ndarray, size: int) -> list[np.ndarray]:
    """For each segment, which of its windows of `size` words occur twice or more in all segments.

    A segment with several copies stands in the index twice and is all repeated.
    """
    many = np.flatnonzero(copies > 1)
    index = FMIndex([*segments, *(segments[k] for k in many)], size)
    windows = np.array([len(s) - size + 1 for s in segments], dtype=np.int64)
    flags = [np.full(n, c > 1) for n, c in zip(windows, copies)]
    live = np.flatnonzero(copies == 1)
    base = index.starts[: len(segments)]
    low, high = np.zeros(len(segments), dtype=np.int64), windows - 1  # windows not known yet
    found = np.zeros(len(segments), dtype=bool)  # the first of them is known to be repeated
    while len(live):
        rise = live[~found[live]]  # the first unknown window: a failure rules out all windows that hold the place of failure
        if len(rise):
            first = base[rise] + low[rise]
            begin = index.reach(first + size - 1, first) - base[rise]
            found[rise] = begin == low[rise]
            low[rise] = begin
        fall = live[found[live]]  # the last one, extended over all unknown windows: success settles all those inside
        if len(fall):
            begin = index.reach(base[fall] + high[fall] + size - 1, base[fall] + low[fall]) - base[fall]
            good = begin <= high[fall]
            for k, b in zip(fall[good], begin[good]):
                flags[k][b : high[k] + 1] = True
            high[fall[good]] = begin[good] - 1
            fall, begin = fall[~good], begin[~good]
            left = np.maximum(low[fall], begin - size)  # windows from here on end where the failure is, or behind it
            begin2 = index.reach(base[fall] + begin - 1, base[fall] + left) - base[fall]
            high[fall] = np.where((begin2 > left) & (begin2 >= high[fall]), left, high[fall]) - 1
        live = live[low[live] <= high[live]]
    return flags
