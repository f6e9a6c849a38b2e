"""FM-index over an array of symbols: suffix array, wavelet-matrix ranks, backward search, sampled locate."""

from __future__ import annotations

import numpy as np

SAMPLE = 32


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Prefix doubling; each round sorts only the suffixes that still tie."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = np.r_[True, s[order][1:] != s[order][:-1]]
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = start
    step = 1
    while True:
        ends = np.r_[first[1:], True]
        tied = np.flatnonzero(~(first & ends))
        if not len(tied):
            return order
        at = order[tied]
        after = at + step
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[tied], key = at[by], key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        first[tied] = new
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        step *= 2


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.r_[bits, np.zeros(-len(bits) % 64 + 64, bits.dtype)], bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """Index of symbols 1..n_symbols-1; a sentinel 0 is added at the end."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        text = np.r_[symbols, 0].astype(np.int64)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.size = len(text)
        self.less = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols))]  # symbols below c
        self.levels: list[tuple[int, Bits, int]] = []
        row = bwt
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), int(len(row) - ones.sum())))
            row = np.r_[row[~ones], row[ones]]
        every = np.arange(n_symbols)
        self.origin = np.zeros(n_symbols, np.int64)
        self.origin = self._down(every, self.origin)
        kept = sa % sample == 0
        self.kept, self.samples = Bits(kept), sa[kept]

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c in the transformed text before i."""
        return self._down(c, i) - self.origin[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns (rows): intervals of the suffix array, empty if absent."""
        low, high = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        live = np.arange(len(patterns))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            lo, hi = self.less[c] + self.rank(c, lo), self.less[c] + self.rank(c, hi)
            on = lo < hi
            live, lo, hi = live[on], lo[on], hi[on]
        low[live], high[live] = lo, hi
        return low, high

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier."""
        c, at = np.zeros(len(i), np.int64), i
        for bit, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            c |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ones, at - ones)
        return self.less[c] + at - self.origin[c]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking back to the nearest sampled position."""
        out, at, todo, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            hit = self.kept.get(at)
            out[todo[hit]] = self.samples[self.kept.rank(at[hit])] + steps
            todo, at, steps = todo[~hit], self.back(at[~hit]), steps + 1
        return out
