"""Periodic runs of words: words outside repeated k-grams are masked, then Main and Lorentz's halving finds the runs of what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import words

#: A run has 6 words at least and four of its periods.
LEAST, PERIODS = 6, 4
#: The words of a run that are equal to those a period later are LEAST - 1 at least with period 1 and 6 with a longer one: so each word
#: of a run is in a k-gram of so many words that occurs again, a period away.
K = min(LEAST - 1, *(max(LEAST, PERIODS * q) - q for q in range(2, 8)))
_BASE, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _segments(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of words inside k-grams that their document has more than once, of LEAST words or more: first, last + 1."""
    none = np.zeros(0, dtype=np.int64)
    n = len(codes)
    if n < LEAST:
        return none, none
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    x = (codes.astype(np.uint64) + np.uint64(1)) * _SALT
    h = document[: n - K + 1].astype(np.uint64) * _SALT
    for j in range(K):
        h = (h ^ (h >> np.uint64(31))) * _BASE + x[j : n - K + 1 + j]
    inside = document[: n - K + 1] == document[K - 1 :]
    again = np.zeros(n - K + 1, dtype=bool)
    at = np.flatnonzero(inside)
    again[at] = pd.Series(h[at]).duplicated(keep=False).to_numpy()
    edge = np.zeros(n + 1, dtype=np.int64)
    hit = np.flatnonzero(again)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + K, -1)
    kept = np.cumsum(edge[:-1]) > 0
    new = np.concatenate([[True], document[1:] != document[:-1]])
    first = np.flatnonzero(kept & (new | ~np.concatenate([[False], kept[:-1]])))
    last = np.flatnonzero(kept & np.concatenate([new[1:] | ~kept[1:], [True]])) + 1
    long = last - first >= LEAST
    return first[long], last[long]


class _Same:
    """Whether stretches of words are equal, by hashes of prefixes; how far two stretches stay equal, by bisection."""

    def __init__(self, codes: np.ndarray):
        x = (codes.astype(np.uint64) + np.uint64(1)) * _SALT
        x ^= x >> np.uint64(29)
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), _BASE)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(x * self.power[:-1])])

    def equal(self, i: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n words from i and from i + p."""
        return (self.sums[i + n] - self.sums[i]) * self.power[p] == self.sums[i + p + n] - self.sums[i + p]

    def ahead(self, i: np.ndarray, p: np.ndarray, end: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(i), dtype=np.int64), end - i - p
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = self.equal(i, p, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    def behind(self, i: np.ndarray, p: np.ndarray, begin: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(i), dtype=np.int64), i - begin
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = self.equal(i - mid, p, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo


def _halves(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """[start, end, period] of the runs within the segments.

    All stretches of one depth are halved together.  A run that lies in a stretch and over its middle has two periods on one
    side at least: two equal stretches of one period each, that begin or end at the middle.  From these it is extended both ways.
    """
    same, found = _Same(codes), [np.zeros((0, 3), dtype=np.int64)]
    left, right, seg = first, last, np.arange(len(first))
    while len(left):
        big = right - left >= LEAST
        left, right, seg = left[big], right[big], seg[big]
        middle, most = (left + right) // 2, (right - left) // PERIODS
        node = np.repeat(np.arange(len(left)), most)
        p = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
        for side in (0, -1):  # begins at the middle, ends at it
            i = middle[node] + 2 * side * p
            fits = i + 2 * p <= right[node] if side == 0 else i >= left[node]
            at, q, k = i[fits], p[fits], node[fits]
            ok = same.equal(at, q, q)
            at, q, k = at[ok], q[ok], k[ok]
            while len(at):
                # The least period of each stretch first: its multiples that begin inside the same run are the same run.
                _, lead = np.unique(k, return_index=True)
                ahead = same.ahead(at[lead], q[lead], last[seg[k[lead]]])
                behind = same.behind(at[lead], q[lead], first[seg[k[lead]]])
                start, end = at[lead] - behind, at[lead] + q[lead] + ahead
                found.append(np.stack([start, end, q[lead]], axis=1))
                of = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]))
                rest = ~((q % q[lead][of] == 0) & (at >= start[of]) & (at + 2 * q <= end[of]))
                rest[lead] = False
                at, q, k = at[rest], q[rest], k[rest]
        left, right, seg = np.concatenate([left, middle]), np.concatenate([middle, right]), np.concatenate([seg, seg])
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(LEAST, PERIODS * runs[:, 2])]
    # Of one stretch the smallest period counts.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])] if len(runs) else runs


def _plain(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of one document period by period: what to do if a hash was wrong."""
    out: dict[tuple[int, int], int] = {}
    for q in range(len(codes) // PERIODS, 0, -1):
        edge = np.diff(np.concatenate([[0], (codes[:-q] == codes[q:]).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b + q - a >= max(LEAST, PERIODS * q):
                out[a, b + q] = q
    return [(a, b, q) for (a, b), q in out.items()]


def document_runs(codes: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """codes: numbers of words, of all documents; document d has those from bounds[d] to bounds[d + 1].  For each (start, length, period), in order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    runs = _halves(codes, *_segments(codes, bounds))
    document = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    wrong = set()
    for d, (a, b, q) in zip(document.tolist(), runs.tolist(), strict=True):
        whole = (a == bounds[d] or codes[a - 1] != codes[a - 1 + q]) and (b == bounds[d + 1] or codes[b] != codes[b - q])
        if not (whole and np.array_equal(codes[a : b - q], codes[a + q : b])):
            wrong.add(d)
        out[d].append((a - int(bounds[d]), b - a, q))
    for d in wrong:
        out[d] = [(a, b - a, q) for a, b, q in _plain(codes[bounds[d] : bounds[d + 1]])]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, runs, best, collapsed of each row of docs.

    runs: (start, length, period) of every run, by start, then period; best: that with the greatest length/period, exactly compared
    (ties: smallest start, then period), null without runs; collapsed: the words that no run holds after its first period, joined by a space.
    Words are what stands between spaces and the controls 9 to 13.  Two words are equal if their bytes are.

    Each text is worked on in its task, several together; a long one in n log n steps.  Nothing is shuffled.  Null and
    empty texts have no words and no runs; null and repeated ids stay, a result for each row; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    table = words.separators()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def exact(w: words.Words) -> np.ndarray:
        """Numbers of words: by their symbols; long words' bytes decide."""
        codes, distinct = pd.factorize(words.symbols(w))
        long = np.flatnonzero(w.end - w.start > 8)
        if len(long):
            known: dict[bytes, int] = {}
            codes[long] = [known.setdefault(w.data[i:j], len(distinct) + len(known)) for i, j in zip(w.start[long].tolist(), w.end[long].tolist(), strict=True)]
        return codes

    def best(runs: list[tuple[int, int, int]]) -> dict | None:
        top = None
        for s, n, q in runs:
            if top is None or n * top[2] > top[1] * q:
                top = (s, n, q)
        return None if top is None else dict(zip(("start", "length", "period"), top, strict=True))

    def collapsed(kept: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
        if runs:
            keep = np.ones(len(kept), dtype=bool)
            for s, n, q in runs:
                keep[s + q : s + n] = False
            kept = [kept[i] for i in np.flatnonzero(keep).tolist()]
        return b" ".join(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.text_slices(batches, 1):
            texts = [t or b"" for t in part.column(1).to_pylist()]
            w = words.split(texts, table)
            runs = document_runs(exact(w), w.bounds)
            columns = [
                part.column(0),
                pa.array(np.diff(w.bounds)),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], pa.list_(run_type)),
                pa.array([best(r) for r in runs], run_type),
                pa.array([collapsed(t.split(), r) for t, r in zip(texts, runs, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "best", "collapsed"])

    kind = rows.schema["id"].dataType.simpleString()
    one = "struct<start: long, length: long, period: long>"
    out = rows.mapInArrow(run, f"id {kind}, n_words long, runs array<{one}>, best {one}, collapsed binary")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", "best", F.col("collapsed").cast("string").alias("collapsed"))
