"""Words of many texts at once, as numpy arrays: where they are and a 64-bit symbol for each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from spindrift.llm.common import slices

_K = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
#: Bytes of text that a worker splits at a time, or one text.
TEXT_BYTES = 8 << 20


def separators(kept: bytes | None = None, lower: bool = False) -> bytes:
    """A table for bytes.translate: separators become spaces.  kept: the ASCII bytes of words, else all but space and the
    controls 9 to 13; other bytes (of non-ASCII characters) are parts of words."""
    white = b" \t\n\v\f\r"
    sep = lambda c: c < 128 and (c not in kept if kept is not None else c in white)
    low = lambda c: c + 32 if lower and 65 <= c <= 90 else c
    return bytes(32 if sep(low(c)) else low(c) for c in range(256))


@dataclass
class Words:
    """Word i is data[start[i]:end[i]]; those of text t are bounds[t] to bounds[t + 1]."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def split(texts: list[bytes], table: bytes) -> Words:
    data = b" ".join(texts).translate(table)
    space = np.frombuffer(data, np.uint8) == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate([[0], edge])
    start = edge[0::2]
    end = edge[1::2] if len(edge) % 2 == 0 else np.append(edge[1::2], len(data))
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(data, start, end, np.searchsorted(start, at))


def symbols(w: Words) -> np.ndarray:
    """64 bits of each word: the word itself up to 8 bytes, of longer ones a hash (two different long words are alike with
    a probability of 2**-64)."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    padded = w.data + bytes(8)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    size = w.end - w.start
    out = eight[w.start] & _MASK[np.minimum(size, 8)]
    left = np.flatnonzero(size > 8)
    at = 8
    while len(left):
        x = out[left] * _K
        x ^= x >> np.uint64(29)
        x = (x ^ (eight[w.start[left] + at] & _MASK[np.minimum(size[left] - at, 8)])) * _K
        out[left] = x ^ (x >> np.uint64(32))
        at += 8
        left = left[size[left] > at]
    return out


def text_slices(batches, column: int, rows: int = 4096):
    """Arrow batches cut so that their texts have TEXT_BYTES bytes at most, or are one text."""
    for b in slices(batches, rows):
        size = b.column(column).cast(pa.binary())
        lengths = np.array([0 if v is None else v for v in pa.compute.binary_length(size).to_pylist()], dtype=np.int64)
        at = 0
        while at < b.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), TEXT_BYTES, side="right")))
            yield b.slice(at, n)
            at += n
