"""Approximate nearest neighbours by learned partitions.

On a bounded sample: a neighbour graph is cut into balanced parts, and a small classifier learns to
tell a vector's part from its neighbours' parts.  Every row is then indexed under its likeliest
part; a query visits its likeliest few parts, whose rows are ranked by exact cosine.  Parts are small and grow
in number with the data, so that the parts that a query visits hold a share of all rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm.common import cut, reading, release, slices
from spindrift.session import share_package

#: Vectors that the graph, the partition and the classifiers are fitted on, at most, and three times as many others that
#: choose how many parts a query visits (smallest hashes of their ids).
SAMPLE = 16_384
#: Parts that one classifier tells apart, at most, what the sample can teach it; beyond, a second one divides each part again.
MAX_PARTS = 2048
#: Similarities that the driver holds at a time while it fits.
NEAR_CELLS = 1 << 21
#: Rows of a block, the unit that a task holds while queries stream past it.
ROW_BLOCK = 8192
#: Recall of held-out queries at which probing stops.
RECALL = 0.95


@dataclass
class Router:
    """One or two classifiers (weights, biases) of unit vectors; a row's part is its likeliest class of each.

    A query visits the parts whose classes' ranks, from 0 for the likeliest, have a sum of `reach` at most.
    """

    heads: list[tuple[np.ndarray, np.ndarray]]
    reach: float

    def scores(self, x: np.ndarray, head: int) -> np.ndarray:
        w, b = self.heads[head]
        return x.astype(np.float32) @ w + b

    def codes(self, x: np.ndarray) -> np.ndarray:
        """[row, head]: the likeliest class; scores of 1,024 rows at a time, as all rows' would fill the driver's memory."""
        out = np.empty((len(x), len(self.heads)), dtype=np.int64)
        for at in range(0, len(x), 1024):
            for h in range(len(self.heads)):
                out[at : at + 1024, h] = self.scores(x[at : at + 1024], h).argmax(axis=1)
        return out

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """[row, head, class]: how many classes are likelier."""
        out = np.empty((len(x), len(self.heads), self.heads[0][1].shape[0]), dtype=np.int32)
        for h in range(len(self.heads)):
            order = np.argsort(-self.scores(x, h), axis=1, kind="stable")
            np.put_along_axis(out[:, h], order, np.arange(order.shape[1], dtype=np.int32)[None], axis=1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by a power of two first, which changes no quotient, so that squares stay finite."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbours(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of x to its rows `of`, themselves left out."""
    out = np.empty((len(of), k), dtype=np.int64)
    step = max(1, NEAR_CELLS // max(1, len(x)))
    for at in range(0, len(of), step):
        rows = of[at : at + step]
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -np.inf
        np.negative(s, out=s)
        out[at : at + step] = np.argpartition(s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.3, rounds: int = 8) -> np.ndarray:
    """Parts of nearly equal size, at most slack times the mean, that keep graph neighbours together.

    Rows go to the nearest centre that has room, the closest ones first; then rows move to the part of most of
    their neighbours while that has room, and centres follow.
    """
    n, room = len(x), int(slack * len(x) / parts) + 1
    centres = x[rng.choice(n, parts, replace=False)].copy()
    label = np.zeros(n, dtype=np.int64)
    for r in range(rounds):
        near = np.empty((n, min(16, parts)), dtype=np.int64)
        best = np.empty(n, dtype=x.dtype)
        for at in range(0, n, 1024):
            s = x[at : at + 1024] @ centres.T
            top = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
            order = np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable")
            near[at : at + 1024] = np.take_along_axis(top, order, axis=1)
            best[at : at + 1024] = s.max(axis=1)
        size = [0] * parts
        choice = near.tolist()
        spare = 0
        for i in np.argsort(-best, kind="stable").tolist():
            for c in choice[i]:
                if size[c] < room:
                    break
            else:
                while size[spare] >= room:
                    spare += 1
                c = spare
            label[i] = c
            size[c] += 1
        if r == rounds - 1:
            _towards_neighbours(label, graph, size, room)
        centres = np.zeros_like(centres)
        np.add.at(centres, label, x)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return label


def _towards_neighbours(label: np.ndarray, graph: np.ndarray, size: list[int], room: int) -> None:
    """Moves rows to the part that most of their graph neighbours are in."""
    for i in range(len(label)):
        parts, votes = np.unique(label[graph[i]], return_counts=True)
        own = votes[parts == label[i]].sum()
        to = int(parts[votes.argmax()])
        if votes.max() > own + 1 and size[to] < room:
            size[label[i]] -= 1
            size[to] += 1
            label[i] = to


def _classifier(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression from the parts' centres on: a fifth of the goal is a row's own part, the rest its neighbours'."""
    w = np.zeros((parts, x.shape[1]), dtype=np.float32)
    np.add.at(w, label, x)
    w = 8 * (w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)).T
    p = [np.ascontiguousarray(w), np.zeros(parts, dtype=np.float32)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    k = graph.shape[1]
    for _ in range(max(4, min(20, 60_000 // len(x)))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            b = order[at : at + 256]
            s = x[b] @ p[0] + p[1]
            e = np.exp(s - s.max(axis=1, keepdims=True))
            d = e / e.sum(axis=1, keepdims=True)
            row = np.arange(len(b))
            np.add.at(d, (row, label[b]), -0.2)
            np.add.at(d, (np.repeat(row, k), label[graph[b]].ravel()), -0.8 / k)
            d /= len(b)
            step += 1
            for i, g in enumerate((x[b].T @ d, d.sum(axis=0))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p[i] -= (0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p[0], p[1]


def fit(sample: np.ndarray, parts: int, others: np.ndarray | None = None, recall: float = RECALL, k: int = 5, heads: int = 1, seed: int = 3) -> Router:
    """The router, fitted on the unit vectors `sample`; its reach is the smallest with which `recall` of the k nearest are found.

    If the sample is not the whole table, that is measured on others: queries and rows that the fit has not seen.
    """
    x = np.unique(sample, axis=0).astype(np.float32)
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    dim = x.shape[1]
    # Four vectors to a part at least, so few different ones in the sample give fewer parts.
    parts = min(parts, 1 << max(0, int(np.log2(max(1, len(x) / 4)))))
    if parts < 2:
        return Router([(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32))], np.inf)
    k = min(k, len(x) - 1)
    graph = neighbours(x, np.arange(len(x)), 16 if len(x) > 16 else len(x) - 1)
    router = Router([], np.inf)
    for _ in range(heads):
        label = balanced_parts(x, graph, parts, rng)
        router.heads.append(_classifier(x, graph, label, parts, rng))
    if others is not None and len(others) > 20 * k:
        x = others.astype(np.float32)
    asked = rng.permutation(len(x))[:2000]
    codes, near = router.codes(x), neighbours(x, asked, k)
    far = np.empty(near.shape, dtype=np.int64)
    for at in range(0, len(asked), 256):
        r = router.ranks(x[asked[at : at + 256]])
        far[at : at + 256] = sum(np.take_along_axis(r[:, h], codes[near[at : at + 256], h], axis=1) for h in range(heads))
    router.reach = float(np.sort(far.ravel())[int(np.ceil(recall * far.size)) - 1])
    return router


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v of the rows that take part: an id, and a vector whose components are finite and not all zero."""
    v = F.transform(F.col(vector_col), lambda a: a.cast("double"))
    ok = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists("v", lambda a: a != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0").where(ok)


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _list(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


def assign(rows: DataFrame, router: Router) -> DataFrame:
    """rows(id, v) -> part (of the first classifier), codes, id, v."""
    share_package(rows.sparkSession)

    def run(batches):
        for b in slices(batches, 2048):
            codes = router.codes(unit(_matrix(b.column("v"))))
            yield pa.RecordBatch.from_arrays([pa.array(codes[:, 0], pa.int32()), _list(codes, pa.int32()), b.column("id"), b.column("v")], ["part", "codes", "id", "v"])

    return rows.select("id", "v").mapInArrow(run, "part int, codes array<int>, id long, v array<double>")


def _asked(queries: DataFrame, router: Router, first: np.ndarray, count: np.ndarray) -> DataFrame:
    """queries(id, v) -> block, id, v: a row for each block that holds a part whose first class the query visits."""

    def run(batches):
        for b in slices(batches, 256):
            near = router.ranks(unit(_matrix(b.column("v"))))[:, 0] <= router.reach
            blocks = [np.unique(np.concatenate([np.arange(first[p], first[p] + count[p]) for p in np.flatnonzero(n)])) for n in near]
            at = pa.array(np.repeat(np.arange(len(blocks)), [len(x) for x in blocks]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks), pa.int64()), b.column("id").take(at), b.column("v").take(at)], ["block", "id", "v"])

    return queries.select("id", "v").mapInArrow(run, "block long, id long, v array<double>")


class Block:
    """Rows that share a task, ordered by part; queries stream past."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, v: np.ndarray):
        order = np.lexsort((ids, *codes.T[::-1]))
        self.codes, self.ids, self.v = codes[order], ids[order], v[order]
        self.unit = unit(self.v)
        edges = np.flatnonzero((np.diff(self.codes, axis=0) != 0).any(axis=1)) + 1
        self.parts = list(zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True))
        self.by_id = np.argsort(self.ids, kind="stable")
        self.starts = np.flatnonzero(np.diff(self.ids[self.by_id], prepend=self.ids[self.by_id][0] - 1))

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, router: Router, k: int) -> tuple[list[tuple], int]:
        """(query, id, score) of each query's k nearest ids among the rows of the parts that it visits, equal scores by id, its own
        id left out, and the number of rows scored.  An id with several rows counts once, with its best score."""
        qu, scored, out = unit(q), 0, []
        ranks = router.ranks(qu)
        s = np.full((len(q), len(self.ids)), -np.inf)
        for lo, hi in self.parts:
            who = (ranks[:, np.arange(self.codes.shape[1]), self.codes[lo]].sum(axis=1) <= router.reach).nonzero()[0]
            if len(who):
                s[who, lo:hi] = qu[who] @ self.unit[lo:hi].T
                scored += len(who) * (hi - lo)
        s[q_ids[:, None] == self.ids[None, :]] = -np.inf
        best = s if len(self.starts) == len(self.ids) else np.maximum.reduceat(s[:, self.by_id], self.starts, axis=1)
        kk = min(k, best.shape[1])
        floor = np.partition(best, best.shape[1] - kk, axis=1)[:, best.shape[1] - kk]
        for i in range(len(s)):
            near = np.flatnonzero((s[i] >= floor[i] - 1e-9) & (s[i] > -np.inf))
            # The same sum for equal vectors, in whatever block they are.
            exact = (self.unit[near] * qu[i]).sum(axis=1)
            order = np.lexsort((self.ids[near], -exact))
            order = order[np.sort(np.unique(self.ids[near][order], return_index=True)[1])][:k]
            out.extend((int(q_ids[i]), int(self.ids[near[o]]), float(exact[o])) for o in order)
        return out, scored


def _search(index: DataFrame, queries: DataFrame, router: Router, k: int) -> DataFrame:
    """index(part, codes, id, v), queries(id, v) -> query_id, vec_id, score, rank, scored: the k nearest of each query in its parts.

    Parts are laid into blocks of about ROW_BLOCK rows, a large part into several by a hash.  A task holds one block's rows and
    streams the queries that visit one of its parts past them, so neither a part's rows nor the queries need fit together.
    """
    sizes = np.zeros(router.heads[0][1].shape[0], dtype=np.int64)
    for r in index.groupBy("part").count().collect():  # MAX_PARTS rows at most
        sizes[r["part"]] = r["count"]
    count = np.maximum(1, -(-sizes // ROW_BLOCK))
    # Small parts share a block until it is full.
    first, at, held = np.zeros(len(sizes), dtype=np.int64), 0, 0
    for p, n in enumerate(sizes):
        if held and (held + n > ROW_BLOCK or count[p] > 1):
            at, held = at + 1, 0
        first[p] = at
        at, held = (at + int(count[p]), 0) if count[p] > 1 else (at, held + int(n))
    # One literal each, not an expression for each part: a plan of thousands of them costs the driver memory.
    of_part = lambda n: F.element_at(F.split(F.lit(",".join(map(str, n.tolist()))), ","), F.col("part") + 1).cast("long")
    rows = index.select((of_part(first) + F.pmod(F.xxhash64("id", "v"), of_part(count))).alias("block"), F.lit(0).alias("kind"), "id", "v", "codes")
    asked = _asked(queries, router, first, count).select("block", F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("array<int>").alias("codes"))
    # Each block is a task's, by its number: hashes would put several into one.
    both = rows.unionByName(asked).repartitionById(at + 1, F.col("block").cast("int")).sortWithinPartitions("block", "kind")

    def run(batches):
        now, held, block = None, [], None
        for b in slices(batches, 1024):
            numbers, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)], strict=True):
                part = b.slice(lo, hi - lo)
                if numbers[lo] != now:
                    now, held, block = numbers[lo], [], None
                ids, v = part.column("id").to_numpy(), _matrix(part.column("v"))
                if kinds[lo] == 0:
                    held.append((_matrix(part.column("codes")), ids, v))
                    continue
                if block is None and held:
                    block, held = Block(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                if block is not None:
                    for at in range(0, len(ids), 256):
                        found, scored = block.nearest(ids[at : at + 256], v[at : at + 256], router, k)
                        # The rows scored are on the batch's first row.
                        cols = list(zip(*found, strict=True)) or [(), (), ()]
                        counted = np.zeros(len(found), dtype=np.int64)
                        counted[:1] = scored
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(counted)], ["query_id", "vec_id", "score", "scored"])

    pairs = both.mapInArrow(run, "query_id long, vec_id long, score double, scored long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("scored").alias("scored"))
    pairs = pairs.withColumn("rank", F.row_number().over(best)).withColumn("all", F.sum("scored").over(Window.partitionBy("query_id"))).where(F.col("rank") <= k)
    return pairs.withColumn("scored", F.when(F.col("rank") == 1, F.col("all")).otherwise(F.lit(0)).cast("long")).drop("all")


def parts_for(rows: int) -> tuple[int, int]:
    """(parts, classifiers): a power of two near 8 * sqrt(rows), two classifiers beyond MAX_PARTS."""
    want = max(0, round(np.log2(8 * max(1.0, rows) ** 0.5)))
    most = int(np.log2(MAX_PARTS))
    heads = 1 if want <= most else 2
    parts = 1 << min(most, want if heads == 1 else max(most - 2, -(-want // 2)))
    return min(parts, 1 << max(0, int(np.log2(max(1, min(rows, SAMPLE) / 5))))), heads


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, parts: int | None = None, heads: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, scored: the k nearest found of each row whose id is divisible by `every`, among all others.

    Scores are exact cosines in double precision, ties go to the smaller id.  Vectors that are null, empty, zero, or hold
    null or non-finite components take no part, nor do null ids; a vector is searched among those of its own length.
    Rows that repeat an id count as that id's: two ids score as the nearest pair of their vectors, and equal rows are indexed once.
    A query that finds fewer than k in its parts is searched over all rows.  parts, heads: as parts_for() has them, unless
    given.  scored, on the rows of rank 1: rows that were compared, summed over all queries of a batch.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = _clean(vectors, id_col, vector_col)
    lengths = [r[0] for r in rows.select(F.size("v")).distinct().collect()]  # one for each length
    found = [_nearest(rows.where(F.size("v") == d), k, every, recall, parts, heads) for d in sorted(lengths)]
    if not found:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"), F.col("id").alias("scored"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if len(found) > 1:  # an id can have vectors of several lengths
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("scored").alias("scored")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return reading(out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "scored"), *found)


def _nearest(rows: DataFrame, k: int, every: int, recall: float, parts: int | None, heads: int | None) -> DataFrame:
    """nearest() of vectors of one length.

    Of the ids of equal vectors the k + 1 smallest are indexed: ties go to the smaller id, so no other can be in a result.  A vector that
    most rows have is k + 1 rows of the index, whatever their number; all rows of a query's id ask.
    """
    total, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
    made = []
    if ids < total:
        rows = cut(rows.dropDuplicates(["id", "v"]))
        made.append(rows)
    of = Window.partitionBy("v").orderBy("id")
    few = cut(rows.withColumn("n", F.row_number().over(of)).where(F.col("n") <= k + 1).drop("n"))
    made.append(few)
    held = few.count()
    first = few.orderBy(F.xxhash64("id", "v"), "id").limit(4 * SAMPLE).select("v").toArrow().column("v").combine_chunks()
    sample = unit(_matrix(first)).astype(np.float32)
    n, h = parts_for(held)
    router = fit(sample[:SAMPLE], parts or n, sample[SAMPLE:] if held > SAMPLE else None, recall, k, heads or h)
    del sample, first
    index = cut(assign(few, router))
    asked = cut(rows.where(F.col("id") % every == 0).select("id", "v"))
    found = cut(_search(index, asked, router, k))
    full = found.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= k)
    short = asked.join(full, F.col("id") == F.col("query_id"), "left_anti")
    out = reading(found, found)
    if ids > 1 and short.take(1):
        short = cut(short)
        every_part = Router(router.heads, np.inf)
        everywhere = cut(_search(index, short, every_part, k))
        out = reading(found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(everywhere), found, short, everywhere)
    release(index, asked, *made)
    return out
