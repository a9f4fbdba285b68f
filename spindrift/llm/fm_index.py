"""An FM-index of a sequence of symbols: suffix order, wavelet matrix of the preceding symbols, sampled positions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols in one index at most: two ranks and a position fit in 60 bits, so that one sort of integers orders suffixes.
MOST = (1 << 20) - 1
SAMPLE = 16


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of s in the order of their suffixes; s[-1] occurs once.  Ranks by 1, 2, 4, .. symbols, of those that still tie."""
    n, low = len(s), (1 << 20) - 1
    at = np.arange(n, dtype=np.int64)
    nxt = np.append(s[1:], 0).astype(np.int64)
    keys = (s.astype(np.int64) << 40) | (nxt << 20) | at
    keys.sort()
    order = keys & low
    rank = np.empty(n, dtype=np.int64)

    def groups(keys: np.ndarray, places: np.ndarray, idx: np.ndarray) -> np.ndarray:
        """Give the ranks of a sorted stretch; the places that tie with others."""
        first = np.empty(len(keys), dtype=bool)
        first[0] = True
        np.not_equal(keys[1:] >> 20, keys[:-1] >> 20, out=first[1:])
        rank[idx] = np.maximum.accumulate(np.where(first, places, 0))
        alone = first.copy()
        alone[:-1] &= first[1:]
        return places[~alone]

    places = groups(keys, at, order)
    step = 2
    while len(places):
        idx = order[places]
        keys = (rank[idx] << 40) | (rank[idx + step] << 20) | idx
        keys.sort()
        idx = keys & low
        order[places] = idx
        places = groups(keys, places, idx)
        step *= 2
    return order


class Bits:
    """A bit vector with ranks, in 64-bit words."""

    def __init__(self, words: np.ndarray, before: np.ndarray):
        self.words, self.before = words, before

    @staticmethod
    def of(b: np.ndarray) -> Bits:
        packed = np.packbits(b, bitorder="little")
        words = np.zeros(len(b) // 64 + 1, dtype="<u8")
        words.view(np.uint8)[: len(packed)] = packed
        before = np.zeros(len(words), dtype="<u4")
        np.cumsum(np.bitwise_count(words)[:-1], dtype="<u4", out=before[1:])
        return Bits(words, before)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        part = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w].astype(np.int64) + np.bitwise_count(part)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


@dataclass
class FmIndex:
    """levels: the wavelet matrix, highest bit first; zeros: those of each level; first: suffixes that begin with a smaller
    symbol than each; jump: what takes a place at the end of the matrix to the suffix one symbol longer; samples: text positions of the marked suffixes."""

    levels: list[Bits]
    zeros: np.ndarray
    first: np.ndarray
    jump: np.ndarray
    marks: Bits
    samples: np.ndarray

    @staticmethod
    def build(text: np.ndarray, sigma: int) -> FmIndex:
        """text: symbols 1 to sigma - 1 and 0 as the end of each document; the last symbol is 0."""
        n = len(text)
        if n > MOST or n == 0 or text[-1] != 0:
            raise ValueError(f"an index takes 1 to {MOST} symbols that end with 0")
        ends = text == 0
        k = int(ends.sum())
        # Each end is a symbol of its own while suffixes are sorted, so no comparison runs into the next document.
        own = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + (k - 1))
        order = suffix_order(own)
        before = text[order - 1]  # at position 0 the last symbol, an end
        counts = np.bincount(text, minlength=sigma)
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        marked = (order % SAMPLE == 0) | (before == 0)
        depth = max(1, int(sigma - 1).bit_length())
        levels, zeros, s = [], [], before.astype(np.uint32)
        for d in range(depth - 1, -1, -1):
            b = (s >> np.uint32(d)) & np.uint32(1) == 1
            levels.append(Bits.of(b))
            rest = s[~b]
            zeros.append(len(rest))
            s = np.concatenate([rest, s[b]])
        out = FmIndex(levels, np.array(zeros, dtype=np.int64), first, np.zeros(sigma, dtype=np.int64), Bits.of(marked), order[marked].astype(np.int32))
        every = np.arange(sigma, dtype=np.int64)
        out.jump = first[:-1] - out._down(np.zeros(sigma, dtype=np.int64), every)
        return out

    def _down(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where the first i preceding symbols' copies of c end, at the bottom of the matrix."""
        depth = len(self.levels)
        for d, bits in enumerate(self.levels):
            one = (c >> (depth - 1 - d)) & 1 == 1
            r = bits.rank(i)
            i = np.where(one, self.zeros[d] + r, i - r)
        return i

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with c and one of lo to hi: a step of the backward search."""
        return self._down(lo, c) + self.jump[c], self._down(hi, c) + self.jump[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: a row of symbols each, -1 in front where one is shorter -> the suffixes lo to hi that begin with each (none: lo = hi)."""
        last = phrases[:, -1]
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.zeros(len(phrases), dtype=np.int64)
        some = last > 0
        lo[some], hi[some] = self.first[last[some]], self.first[last[some] + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            on = np.flatnonzero((phrases[:, j] >= 0) & (lo < hi))
            if not len(on):
                break
            lo[on], hi[on] = self.extend(lo[on], hi[on], phrases[on, j])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: back symbol by symbol to a sampled one; a document's first is one."""
        out, steps = np.zeros(len(rows), dtype=np.int64), 0
        on, at, depth = np.arange(len(rows)), rows.astype(np.int64), len(self.levels)
        while len(on):
            found = self.marks.get(at)
            out[on[found]] = self.samples[self.marks.rank(at[found])] + steps
            on, at = on[~found], at[~found]
            c = np.zeros(len(on), dtype=np.int64)
            for d, bits in enumerate(self.levels):
                one, r = bits.get(at), bits.rank(at)
                c = (c << 1) | one
                at = np.where(one, self.zeros[d] + r, at - r)
            at += self.jump[c]
            steps += 1
        return out
