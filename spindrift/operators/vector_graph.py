"""Graph search: every vector knows its nearest ones, found by asking the neighbours' neighbours; queries walk from there in rounds."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.operators import dense
from spindrift.operators.vector_index import usable
from spindrift.tables import cut, reading, release

#: Rows that are compared with each other when a graph is begun, a run of them along a random direction.
RUN = 64
#: Rows that a walk may begin at, by hash; each query begins at the best of them.
ENTRIES = 64
#: Meetings that a task scores before it gives their pairs out; bytes of query vectors that are broadcast at most.
MEETINGS, QUERY_BYTES = 256, 64 << 20


def _score(a: Column, b: Column, metric: str) -> Column:
    return dense.dot(a, b) if metric == "ip" else -dense.squared_distance(a, b)


def _best(pairs: DataFrame, k: int, by: str = "a", other: str = "b") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), other)
    return pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def _met(links: DataFrame, rows: DataFrame, graph: DataFrame, degree: int, metric: str) -> DataFrame:
    """links(a, b) -> a, b, score: at each row those that link to it meet those that it links to; at most `degree` for each that are
    nearer than its farthest neighbour.

    Vectors are sent twice for each link, as they are stored, not once for each pair.  A meeting is scored as one matrix: it has 2 * degree rows that
    are linked to and as many that link there; a hub has several meetings.
    """
    full = F.count("*") >= degree
    worst = graph.groupBy("a").agg(F.when(full, F.min("score")).otherwise(float("-inf")).alias("worst"))
    known = rows.select("doc", "v").join(worst.withColumnRenamed("a", "doc"), "doc", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
    n = F.row_number().over(Window.partitionBy("b").orderBy("a"))
    coming = links.join(known.withColumnRenamed("doc", "a"), "a").withColumn("part", F.floor((n - 1) / (2 * degree)))
    coming = coming.groupBy("b", "part").agg(F.collect_list(F.struct("a", "worst", "v")).alias("m"))
    there = links.select(F.col("a").alias("b"), F.col("b").alias("doc")).join(rows.select("doc", "v"), "doc").groupBy("b").agg(F.collect_list(F.struct("doc", "v")).alias("o"))
    meetings = coming.join(there, "b").select("m", "o")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, MEETINGS):
                out = [[], [], []]
                for m, o in zip(batch.column("m").slice(at, MEETINGS), batch.column("o").slice(at, MEETINGS), strict=True):
                    m, o = m.values, o.values
                    ids, worst, to = m.field("a"), m.field("worst").to_numpy(), o.field("doc")
                    v, w = (x.field("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1) for x in (m, o))
                    near = v @ w.T
                    if metric != "ip":
                        near = 2 * near - (v * v).sum(1)[:, None] - (w * w).sum(1)[None, :]
                    same = np.asarray(ids.to_pylist(), dtype=object)[:, None] == np.asarray(to.to_pylist(), dtype=object)[None, :]
                    near[same | (near <= worst[:, None])] = -np.inf
                    k = min(degree, len(to))
                    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    score = np.take_along_axis(near, best, 1)
                    x, y = np.nonzero(score > -np.inf)
                    for column, part in zip(out, (ids.take(pa.array(x)), to.take(pa.array(best[x, y])), pa.array(score[x, y])), strict=True):
                        column.append(part)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in out], ["a", "b", "score"])

    kind = rows.schema["doc"].dataType.simpleString()
    return meetings.mapInArrow(run, f"a {kind}, b {kind}, score double")


def _direction(v: Column, seed: int) -> Column:
    """A projection on a random direction, whose components are hashes."""
    part = lambda x, i: x * (F.xxhash64(F.lit(seed), i).cast("double") / float(1 << 63))
    return F.aggregate(F.transform(v, part), F.lit(0.0), lambda s, x: s + x)


def begin(rows: DataFrame, degree: int, metric: str, seed: int) -> DataFrame:
    """a, b, score: within runs of RUN rows along a random direction, each row's best; runs are dealt by range and cut by place, so that none is
    larger, however many rows are alike."""
    placed = rows.select("doc", "v", _direction(F.col("v"), seed).alias("p")).repartitionByRange("p", "doc").sortWithinPartitions("p", "doc")
    numbered = placed.withColumn("run", F.floor(F.monotonically_increasing_id() / RUN))
    runs = numbered.groupBy("run").agg(F.collect_list(F.struct("doc", "v")).alias("m"))  # RUN rows at most
    pairs = runs.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).where(F.col("x.doc") != F.col("y.doc"))
    return _best(pairs.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), _score(F.col("x.v"), F.col("y.v"), metric).alias("score")), degree)


def build(rows: DataFrame, degree: int = 24, rounds: int = 4, begins: int = 3, metric: str = "ip", seed: int = 7) -> DataFrame:
    """rows(doc, v) with unique ids -> a, b, score: the degree nearest found of each row.

    Begun by runs along `begins` directions; in each round a row meets its neighbours' neighbours, in both directions of an edge, and keeps
    the best.  Of the edges that point at a row the best `degree` count, so a row that all point at makes no more candidates than others.
    A round sends a vector twice for each of its links and pairs as two ids and a score; no row is collected.  Rows without a usable vector are left out.
    """
    rows = rows.where(usable(F.col("v"))).select("doc", "v")
    double = rows.withColumn("v", F.transform("v", lambda x: x.cast("double")))
    first = reduce(DataFrame.unionByName, (begin(double, degree, metric, seed + i) for i in range(begins)))
    graph = cut(_best(first.distinct(), degree))
    for _ in range(rounds):
        back = _best(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"), degree)
        known = graph.unionByName(back)
        links = cut(known.select("a", "b").distinct())
        every = known.unionByName(_met(links, rows, graph, degree, metric))
        better = cut(_best(every.groupBy("a", "b").agg(F.max("score").alias("score")), degree))
        release(graph, links)
        graph = better
    return reading(graph, graph)


def search(rows: DataFrame, graph: DataFrame, queries: DataFrame, k: int = 10, beam: int = 32, most: int = 30, metric: str = "ip") -> DataFrame:
    """queries(query, qv) -> query, doc, score, rank, scored: the k best that a walk over the graph finds.

    Each query begins at the best of ENTRIES rows.  In a round it follows the edges, either way, of those of its `beam` best that it hasn't
    followed yet, and scores what it hasn't seen; all queries go together.  It ends when a round changes no query's
    best, or after `most` rounds.  scored: rows that were compared with the query.  Null and unusable queries have no row.
    """
    rows = rows.where(usable(F.col("v"))).select("doc", F.transform("v", lambda x: x.cast("double")).alias("v"))
    asked = queries.where(usable(F.col("qv"))).select("query", F.transform("qv", lambda x: x.cast("double")).alias("qv"))
    both = graph.select("a", "b").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    w = Window.partitionBy("a").orderBy(F.xxhash64("b"))
    # Of a hub's edges as many as a walk can use.
    links = cut(both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= 4 * beam).drop("n"))
    entries = rows.orderBy(F.xxhash64(F.col("doc").cast("string"))).limit(ENTRIES)
    score = _score(F.col("v"), F.col("qv"), metric)
    start = asked.crossJoin(F.broadcast(entries)).select("query", "doc", score.alias("score"), F.lit(False).alias("followed"))
    seen = cut(start)
    held = asked.agg(F.sum(8 * F.size("qv") + 16)).first()[0] or 0
    asked = F.broadcast(asked) if held <= QUERY_BYTES else asked
    made = [seen]
    for _ in range(most):
        top = _best(seen, beam, "query", "doc")
        front = top.where(~F.col("followed")).select("query", "doc")
        near = front.join(links.select(F.col("a").alias("doc"), F.col("b").alias("to")), "doc").select("query", F.col("to").alias("doc")).distinct()
        new = near.join(seen.select("query", "doc"), ["query", "doc"], "left_anti")
        fresh = new.join(rows, "doc").join(asked, "query").select("query", "doc", score.alias("score"), F.lit(False).alias("followed"), F.lit(True).alias("fresh"))
        went = front.withColumn("went", F.lit(True))
        old = seen.join(went, ["query", "doc"], "left").select("query", "doc", "score", (F.col("followed") | F.coalesce("went", F.lit(False))).alias("followed"), F.lit(False).alias("fresh"))
        now = cut(old.unionByName(fresh))
        made.append(now)
        seen = now.drop("fresh")
        if now.where("fresh").isEmpty():
            break
        release(*made[:-1])
        made = made[-1:]
    work = seen.groupBy("query").agg(F.count("*").alias("scored"))
    top = _best(seen.withColumn("score", F.round("score", 6)), k, "query", "doc").join(work, "query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return reading(top.select("query", "doc", "score", rank.alias("rank"), "scored"), links, *made)
