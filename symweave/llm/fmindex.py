"""An FM-index over a sequence of small integers, with all operations vectorised over many patterns."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; a shorter suffix comes before a longer one.

    Only suffixes whose rank is still shared are sorted again, so long repeats cost little.
    """
    n = len(seq)
    if n == 0:
        return np.empty(0, np.int64)
    order = np.argsort(seq, kind="stable")
    key = seq[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    shared = np.flatnonzero(~(new & np.append(new[1:], True)))
    step = 1
    while len(shared):
        at = order[shared]
        group = rank[at]
        after = at + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        o = np.lexsort((second, group))
        at, group, second = at[o], group[o], second[o]
        order[shared] = at
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        start = np.maximum.accumulate(np.where(new, shared, 0))
        rank[at] = start
        shared = shared[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class _Bits:
    """A bit vector with constant-time ranks: words of 64 bits and the count before each of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Rank queries on a sequence over ``[0, 2**bits)``: one bit vector per bit, a fifth of a byte a symbol and bit."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.n = bits, len(seq)
        self.ones: list[_Bits] = []
        self.zeros: list[int] = []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.ones.append(_Bits(bit))
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before position ``at``."""
        begin, end = np.zeros_like(at), at
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((symbol >> b) & 1).astype(bool)
            o0, o1 = ones.rank(begin), ones.rank(end)
            begin = np.where(one, zeros + o0, begin - o0)
            end = np.where(one, zeros + o1, end - o1)
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the positions."""
        out = np.zeros_like(at)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            bit, before = ones[at], ones.rank(at)
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + before, at - before)
        return out


class FMIndex:
    """Backward search and location on ``seq`` (values from 1 up; 0 is the end mark, added here)."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 16):
        seq = np.append(seq.astype(np.int64), 0)
        sa = suffix_array(seq)
        self.n, self.sample = len(seq), sample
        bits = max(1, int(sigma).bit_length())
        bwt = seq[sa - 1]
        self.wavelet = WaveletMatrix(bwt, bits)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma + 1)))).astype(np.int64)
        marked = sa % sample == 0
        self.marked = _Bits(marked)
        self.samples = sa[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges ``[lo, hi)`` of the rows of ``patterns``, all of one length."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            c = patterns[live, j]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to the next sampled position and add the steps."""
        at, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        out = np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marked[at] == 1
            out[todo[hit]] = self.samples[self.marked.rank(at[hit])] + steps[hit]
            todo, at, steps = todo[~hit], at[~hit], steps[~hit] + 1
            if len(todo):
                c = self.wavelet.access(at)
                at = self.first[c] + self.wavelet.rank(c, at)
        return out
