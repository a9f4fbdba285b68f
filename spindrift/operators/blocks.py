"""Best rows of blocks: a task scores its rows against all queries with arrays and hands on each query's best rows, not its pairs."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that a task holds at once.
SCORES = 1 << 22
#: Queries that meet a batch of vectors at once.
TILE = 512
#: Pairs of a posting and a query that are added up at once.
PAIRS = 1 << 20


def micro(score: np.ndarray) -> np.ndarray:
    """Millionths, rounded as Spark rounds a double to 6 digits: half up by its shortest decimal form."""
    y = score * 1e6
    n = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(np.abs(y + 0.5 - n) - 0.5) >= 0.5 - 1e-6 - np.abs(y) * 1e-15):
        n[i] = float(Decimal(repr(float(score[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6))
    return n


def best(group: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each group by rounded score, ties to the smaller place."""
    order = np.lexsort((place, -micro(score), group))
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < k]


def places(ids: pa.Array) -> np.ndarray:
    """Where each value comes in Spark's ascending order, nulls first."""
    out = np.empty(len(ids), dtype=np.int64)
    out[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return out


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length, none null."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)


def exact(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs, component after component, as dense.dot() and dense.squared_distance() add them up."""
    s = np.zeros(len(v))
    for j in range(v.shape[1]):
        x, y = v[:, j], q[:, j]
        s += x * y if metric == "ip" else (x - y) * (x - y)
    return s if metric == "ip" else -s


def nearest(v: np.ndarray, q: np.ndarray, place: np.ndarray, k: int, metric: str, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, query, score) of the k best rows of each query; matrix products choose, exact() scores what they leave.

    floor: the best k-th score of each query so far, by which later blocks are cut as well; it is raised in place.
    """
    n, squares = len(v), (v * v).sum(axis=1)
    longest = np.sqrt(squares.max()) if n else 0.0
    for a in range(0, len(q) if n else 0, TILE):
        some, least = q[a : a + TILE], floor[a : a + TILE]
        s = some @ v.T
        own = (some * some).sum(axis=1)
        if metric == "l2":
            s = 2 * s - squares - own[:, None]
        if n >= k:
            np.maximum(least, np.partition(s, n - k, axis=1)[:, n - k], out=least)
        slack = 2e-6 + 1e-11 * (np.sqrt(own) + longest) ** 2
        at, row = np.nonzero(s >= (least - slack)[:, None])
        score = exact(v[row], some[at], metric)
        kept = best(at, score, place[row], k)
        yield row[kept], a + at[kept], score[kept]


class Weights:
    """Query weights by term: those of term t are query[ptr[t] : ptr[t + 1]] and weight[..] likewise."""

    def __init__(self, term: np.ndarray, query: np.ndarray, weight: np.ndarray, terms: int, queries: int):
        order = np.argsort(term, kind="stable")
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))]).astype(np.int64)
        self.query, self.weight, self.queries = query[order].astype(np.int64), weight[order], queries

    def add(self, sums: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Adds each posting's value, by the weights of its term, to its document's row of sums; postings come document after document."""
        counts = self.ptr[term + 1] - self.ptr[term]
        upto = np.cumsum(counts)
        a = 0
        while a < len(term):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
            c = counts[a:b]
            pair = np.arange(c.sum()) + np.repeat(self.ptr[term[a:b]] - (np.cumsum(c) - c), c)
            low, wide = doc[a], self.queries
            added = np.bincount(np.repeat((doc[a:b] - low) * wide, c) + self.query[pair], weights=np.repeat(value[a:b], c) * self.weight[pair], minlength=int(doc[b - 1] - low + 1) * wide)
            sums[low : doc[b - 1] + 1] += added.reshape(-1, wide)
            a = b


class Scores:
    """Scores of a task's documents by all queries; the documents' postings come one document after the other, in order of the id."""

    def __init__(self, weights: Weights, k: int, most: int):
        self.w, self.k, self.size = weights, k, max(k, 1, most // max(1, weights.queries))
        self.sums = np.zeros((self.size, weights.queries))
        self.docs: list[pa.Array] = []
        self.n, self.last = 0, None

    def add(self, ids: pa.Array, term: np.ndarray, value: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Takes postings; a full block gives (documents, queries, scores) of each query's k best and is emptied."""
        runs = pc.run_end_encode(ids)
        values, ends = runs.values, runs.run_ends.to_numpy().astype(np.int64)
        i = at = 0
        while i < len(ends):
            same = int(i == 0 and self.n > 0 and self.last == values[0].as_py())
            base = self.n - same
            take = min(len(ends) - i, self.size - base)
            if not take:
                yield from self.flush()
                continue
            stop = ends[i + take - 1]
            self.w.add(self.sums, np.repeat(np.arange(base, base + take), np.diff(ends[i : i + take], prepend=at)), term[at:stop], value[at:stop])
            self.docs.append(values.slice(i + same, take - same))
            self.n, i, at = base + take, i + take, stop
            self.last = values[i - 1].as_py()

    def flush(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        if not self.n:
            return
        s = self.sums[: self.n]
        keep = s > 0
        if self.n > self.k:
            keep &= s >= np.partition(s, self.n - self.k, axis=0)[self.n - self.k] - 2e-6
        doc, query = np.nonzero(keep)
        score = s[doc, query]
        kept = best(query, score, doc, self.k)
        yield pa.concat_arrays(self.docs).take(pa.array(doc[kept])), query[kept], score[kept]
        s[:] = 0
        self.docs, self.n = [], 0
