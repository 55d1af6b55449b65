"""An FM-index over a sequence of small integers, with vectorised search.

Symbol 0 separates: no pattern holds it, and separators count as distinct,
smaller ones standing earlier. Suffixes are therefore fully ordered by what
stands before the next separator and then by place. The Burrows-Wheeler
transform of the suffix order is held in a wavelet matrix whose ranks answer
backward search; every `sample`-th suffix place is kept, from which others
are found by stepping back through the transform.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix places in order: packed symbols first, then doubling over the suffixes still tied."""
    n, bits = len(text), max(1, int(sigma - 1).bit_length())
    width = max(1, 63 // bits)
    padded = np.zeros(n + width, np.uint64)
    padded[:n] = text
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(width):
        symbol = padded[k : k + n]
        alive &= symbol > 0
        key = (key << np.uint64(bits)) | np.where(alive, symbol, np.uint64(0))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # a suffix that met a separator is settled: equal ones stand by place
    closed = ~alive[order]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.where(closed, np.arange(n), group)
    rank[n] = -1
    single = new & np.append(new[1:], True)
    tied = np.flatnonzero(~closed & ~single)
    span = width
    while len(tied):
        place, first = order[tied], rank[order[tied]]
        after = rank[np.minimum(place + span, n)]
        by = np.lexsort((place, after, first))
        place, first, after = place[by], first[by], after[by]
        order[tied] = place
        differs = np.ones(len(tied), bool)
        differs[1:] = (first[1:] != first[:-1]) | (after[1:] != after[:-1])
        start = np.maximum.accumulate(np.where(differs, tied, 0))
        rank[place] = start
        tied = tied[~(differs & np.append(differs[1:], True))]
        span *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit plane a bit, highest first, each plane dealt by its bit."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        now = values.astype(np.uint32)
        for level in reversed(range(self.bits)):
            bit = ((now >> np.uint32(level)) & np.uint32(1)).astype(bool)
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[~bit], now[bit]])
        symbols = np.arange(sigma)
        self.begin = self._down(symbols, np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ones[at].astype(np.int64)
            bit = (symbol >> (self.bits - 1 - level)) & 1
            at = np.where(bit == 1, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbol, at) - self.begin[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, sample: int = 4):
        text = np.append(text, 0)  # the last symbol stands before a separator, too
        n = len(text)
        order = suffix_order(text, sigma)
        before = np.where(order > 0, text[np.maximum(order - 1, 0)], 0)
        self.n, self.last = n, before
        self.matrix = WaveletMatrix(before, sigma)
        self.less = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.less[1:])
        # a walk never steps over a separator: suffixes behind one are kept too
        kept = (order % sample == 0) | (before == 0)
        self.kept = kept
        self.kept_before = np.zeros(n + 1, np.int64)
        np.cumsum(kept, out=self.kept_before[1:])
        self.samples = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of patterns, which stand right-aligned in the rows of a matrix."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        left = np.flatnonzero(lengths > 0)
        hi[lengths == 0] = 0
        for step in range(patterns.shape[1]):
            left = left[(lengths[left] > step) & (lo[left] < hi[left])]
            if not len(left):
                break
            symbol = patterns[left, patterns.shape[1] - 1 - step]
            lo[left] = self.less[symbol] + self.matrix.rank(symbol, lo[left])
            hi[left] = self.less[symbol] + self.matrix.rank(symbol, hi[left])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows."""
        at, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.kept[at[left]]
            out[left[done]] = self.samples[self.kept_before[at[left[done]]]] + steps
            left = left[~done]
            symbol = self.last[at[left]]
            at[left] = self.less[symbol] + self.matrix.rank(symbol, at[left])
            steps += 1
        return out
