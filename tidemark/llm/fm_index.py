"""FM-index over an array of word hashes: suffix order, wavelet-tree ranks, sampled positions.

Works on one shard inside a task; all queries of a shard move together as arrays.
"""

from __future__ import annotations

import numpy as np


def suffix_order(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of integers in [0, sigma); prefix doubling that sorts again only the
    suffixes not yet told apart."""
    n = len(t)
    key = t.astype(np.int64) * (sigma + 1)
    key[:-1] += t[1:] + 1
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 2
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return sa
        pos = sa[slots]
        ahead = pos + h
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[pos] * (n + 1) + after
        o = np.argsort(key, kind="stable")
        key, pos = key[o], pos[o]
        sa[slots] = pos
        first = np.ones(len(slots), bool)
        first[1:] = key[1:] != key[:-1]
        new[slots] = first
        rank[pos] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        h *= 2


class _Bits:
    """Bit vector with rank: packed 64-bit words and counts before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((n >> 6) + 1, np.uint64)
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


class FMIndex:
    """Index of ``words`` (uint64); a hash that stands for a break must occur in no phrase."""

    def __init__(self, words: np.ndarray, sample: int = 16):
        self.alphabet, t = np.unique(words, return_inverse=True)
        t = np.concatenate((t.astype(np.int64) + 1, [0]))               # 0 ends the shard
        sigma = len(self.alphabet) + 1
        sa = suffix_order(t, sigma)
        bwt = t[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=sigma))))
        self.n = len(t)
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels = []
        for bit in range(self.depth - 1, -1, -1):                       # wavelet matrix of the BWT
            on = (bwt >> bit & 1).astype(bool)
            self.levels.append(_Bits(on))
            bwt = np.concatenate((bwt[~on], bwt[on]))
        marked = sa % sample == 0
        self.marks = _Bits(marked)
        self.positions = sa[marked]

    def _ranks(self, c: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of symbols c among the first i entries of the BWT, for each i of ends."""
        at = [np.zeros_like(c), *ends]
        for bit, level in zip(range(self.depth - 1, -1, -1), self.levels):
            one = c >> bit & 1 == 1
            at = [np.where(one, level.zeros + r, i - r) for i in at for r in (level.rank(i),)]
        return [i - at[0] for i in at[1:]]

    def _back(self, i: np.ndarray) -> np.ndarray:
        """Row of the suffix one position earlier (LF mapping)."""
        at, start, c = i, np.zeros_like(i), np.zeros_like(i)
        for level in self.levels:
            one = level.get(at)
            r, s = level.rank(at), level.rank(start)
            at = np.where(one, level.zeros + r, at - r)
            start = np.where(one, level.zeros + s, start - s)
            c = c * 2 + one
        return self.first[c] + at - start

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows of hashes, padded): row ranges [lo, hi)."""
        m = len(lengths)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.flatnonzero(lengths > 0)
        hi[lengths == 0] = 0
        for step in range(int(lengths.max(initial=0))):
            live = live[(hi[live] > lo[live])]
            act = live[lengths[live] > step]
            if not len(act):
                break
            h = phrases[act, lengths[act] - 1 - step]
            c = np.minimum(np.searchsorted(self.alphabet, h), len(self.alphabet) - 1)
            known = self.alphabet[c] == h
            hi[act[~known]] = lo[act[~known]]
            act, c = act[known], c[known].astype(np.int64) + 1
            if len(act):
                a, b = self._ranks(c, lo[act], hi[act])
                lo[act], hi[act] = self.first[c] + a, self.first[c] + b
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of all occurrences, through the sampled positions."""
        count = np.maximum(hi - lo, 0)
        phrase = np.repeat(np.arange(len(lo)), count)
        row = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + lo[phrase]
        pos = np.full(len(row), -1, np.int64)
        todo, steps = np.arange(len(row)), 0
        while len(todo):
            hit = self.marks.get(row[todo])
            done = todo[hit]
            pos[done] = self.positions[self.marks.rank(row[done])] + steps
            todo = todo[~hit]
            row[todo] = self._back(row[todo])
            steps += 1
        return phrase, pos
