"""An FM-index over sequences of words: suffix array, packed wavelet matrix of the BWT, and backward search.

The searches of many patterns run in step: each call advances all of them by one word, so the work is in NumPy.
"""

from __future__ import annotations

import numpy as np


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling until all ranks differ.  Only suffixes still tied are sorted again."""
    n = len(ids)
    if n < 2:
        return np.arange(n)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(sorted_ids[1:], sorted_ids[:-1], out=first[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    while True:
        stops = np.append(first[1:], True)
        tied = np.flatnonzero(~(first & stops))
        if not len(tied):
            return order
        at = order[tied]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        again = np.argsort(key, kind="stable")
        key = key[again]
        order[tied] = at[again]
        new = np.empty(len(tied), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        first[tied] = new
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        step *= 2


class Bits:
    """A bit vector in words of 64 with the count before each: rank of one takes one look-up and one popcount."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """Counts of patterns in a list of sequences of word ids from 1; each sequence has a weight, which its occurrences count."""

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray):
        lengths = np.array([len(s) for s in sequences], np.int64)
        n = int(lengths.sum()) + len(sequences)
        ids = np.zeros(n, np.int64)
        ends = np.cumsum(lengths + 1) - 1
        self.starts = ends - lengths
        body = np.ones(n, bool)
        body[ends] = False
        ids[body] = np.concatenate(sequences)
        distinct = np.where(body, ids + len(sequences), 0)
        distinct[ends] = np.arange(len(sequences))  # every sequence ends with a symbol of its own, below all words
        order = suffix_array(distinct)
        bwt = ids[order - 1]
        self.n, self.ids = n, ids
        counts = np.bincount(ids)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.weight = np.zeros(n + 1, np.int64)
        owner = np.zeros(n, np.int64)
        owner[ends[:-1] + 1] = 1
        np.cumsum(np.asarray(weights, np.int64)[np.cumsum(owner)][order], out=self.weight[1:])
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, int(counts.size - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> level) & 1
            bits = Bits(bit.astype(np.uint8))
            self.levels.append((level, bits, n - bits.ones))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))

    def step(self, low: np.ndarray, high: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of each pattern with one word put before it."""
        k = len(low)
        at, base = np.concatenate((low, high)), np.zeros(k, np.int64)
        for level, bits, zeros in self.levels:
            ones = bits.rank(np.concatenate((at, base)))
            up = ((word >> level) & 1).astype(bool)
            up3 = np.concatenate((up, up, up))
            moved = np.where(up3, ones + zeros, np.concatenate((at, base)) - ones)
            at, base = moved[: 2 * k], moved[2 * k :]
        first = self.before[word]
        return first + at[:k] - base, first + at[k:] - base

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]


def repeated(index: FMIndex, which: np.ndarray, lengths: np.ndarray, window: int, least: int = 2) -> list[tuple[int, int, int]]:
    """(sequence, start, end) of the maximal intervals, of ``window`` words at least, that occur ``least`` times.

    Every sequence of ``which`` is read from its end.  From an end, backward search goes left as far as the words
    occur often enough: the matching statistic there.  If that covers a window, the interval is reported, and
    the next end lies such that the next window starts one word further left.  If not, one short probe inside the
    windows that remain rules most of them out at once where the text is unlike any other.
    """
    probe = min(10, window)
    k = len(which)
    base = index.starts[which]
    end = lengths.astype(np.int64).copy()  # windows that end here or before are still to be judged
    probing = np.zeros(k, bool)
    low, high, at = np.zeros(k, np.int64), np.full(k, index.n, np.int64), end.copy()
    found: list[tuple[int, int, int]] = []
    live = np.flatnonzero(end >= window)
    while len(live):
        go = live[at[live] > 0]
        can = np.zeros(k, bool)
        if len(go):
            lo, hi = index.step(low[go], high[go], index.ids[base[go] + at[go] - 1])
            enough = index.count(lo, hi) >= least
            ok = go[enough]
            low[ok], high[ok] = lo[enough], hi[enough]
            at[ok] -= 1
            can[ok] = True
        # a probe that reaches the start of the last window says nothing more
        spent = live[probing[live] & can[live] & (at[live] <= end[live] - window)]
        stopped = live[~can[live]]
        p, s = stopped[probing[stopped]], stopped[~probing[stopped]]
        end[p] -= window - probe + 1
        hit = s[end[s] - at[s] >= window]
        found += zip(hit.tolist(), at[hit].tolist(), end[hit].tolist(), strict=True)
        miss = s[end[s] - at[s] < window]
        end[hit] = at[hit] + window - 1
        end[miss] -= 1
        for again, mode in ((p, True), (miss, True), (hit, False), (spent, False)):
            probing[again] = mode
            low[again], high[again] = 0, index.n
            at[again] = end[again] - (window - probe if mode else 0)
        live = live[end[live] >= window]
    return found
