"""Exact and partitioned vector search over array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spindrift.operators import blocks
from spindrift.operators.sparse import top_k


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """A unit vector; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


#: A query set is broadcast up to so many bytes; a larger one is searched part by part.
BROADCAST_BYTES = 64 << 20


def encode(load: Callable[[], Callable[[list[str]], list[list[float]]]], text: Column, batch: int = 32) -> Column:
    """Vectors of texts by a model: `load` is called once in a worker, its result with lists of at most `batch` texts."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for p in parts:
            t = [x or "" for x in p]
            yield pd.Series([v for at in range(0, len(t), batch) for v in model(t[at : at + batch])])

    return run(text)


def lookup(rows: DataFrame, doc) -> DataFrame:
    """A document's row of an index."""
    return rows.where(F.col("doc") == F.lit(doc))


def regular(col: Column, dim: int) -> Column:
    """Vectors of dim finite components."""
    return F.coalesce((F.size(col) == dim) & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def nearest_rows(rows: DataFrame, queries: DataFrame, k: int, metric: str, dim: int, probes: dict[int, np.ndarray] | None = None, asked: pa.Table | None = None) -> DataFrame:
    """rows(v, doc, ...) x queries(qv, query, ...), all vectors regular -> both tables' columns but the vectors, and score: of each batch
    of rows each query's k best, among them the k best of all.

    probes: a row's cell -> positions of the queries that meet it; without it all do.  The queries (asked: their rows, if at hand) are sent to
    the tasks.
    """
    asked = (queries.toArrow() if asked is None else asked).combine_chunks()
    there = [c for c in asked.column_names if c != "qv"]
    sent = asked.select(there).to_batches()
    vectors = blocks.matrix(asked["qv"].combine_chunks(), dim)
    shared = rows.sparkSession.sparkContext.broadcast((vectors, sent[0] if sent else None, probes))
    here = [c for c in rows.columns if c != "v"]
    out = StructType([*(rows.schema[c] for c in here), *(queries.schema[c] for c in there), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, facts, probes = shared.value
        floor = np.full(len(q), -np.inf)
        for batch in batches if len(q) else ():
            v, place = blocks.matrix(batch.column("v"), dim), blocks.places(batch.column("doc"))
            if probes is None:
                groups = [(slice(None), np.arange(len(q)))]
            else:
                cell = batch.column("cell").to_numpy()
                groups = [(np.flatnonzero(cell == c), probes[c]) for c in np.unique(cell) if c in probes]
            for at, some in groups:
                least, which = floor[some], np.arange(len(v))[at]
                for row, query, score in blocks.nearest(v[at], q[some], place[at], k, metric, least):
                    mine, theirs = pa.array(which[row]), pa.array(some[query])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(mine) for c in here), *(facts.column(c).take(theirs) for c in there), pa.array(score)], names=out.names)
                floor[some] = least

    return rows.mapInArrow(run, out)


def search(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip", keep: Column | None = None, limit_first: bool = False) -> DataFrame:
    """rows(doc, v, ...) x queries(query, qv, ...) -> query, doc, score, rank.

    Every query meets every row, as it must for an exact answer: the query set is sent to all tasks if its bytes, counted first, are
    BROADCAST_BYTES at most; a larger one is cut by hash into so many parts that each is, and rows are read once for each.  Vectors
    meet as matrices and a batch of rows hands on each query's best only.  Null, ragged and infinite vectors, and what `keep` has to
    see before the limit, meet pair by pair.
    keep: which pairs count; with limit_first it applies after the top k.
    """
    first = keep is not None and not limit_first
    size, dim = queries.agg(F.sum(F.size("qv") * 8 + 64), F.max(F.size("qv"))).first()
    parts = -(-(size or 0) // BROADCAST_BYTES)
    score = dot(F.col("v"), F.col("qv")) if metric == "ip" else -squared_distance(F.col("v"), F.col("qv"))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right), keep if first else F.lit(True)).withColumn("score", score).drop("v", "qv")

    def one(some: DataFrame) -> DataFrame:
        if first or not dim or dim < 1:
            found = pairs(rows, some)
        else:
            ours, theirs = regular(F.col("v"), dim), regular(F.col("qv"), dim)
            found = nearest_rows(rows.where(ours), some.where(theirs), k, metric, dim)
            found = found.unionByName(pairs(rows.where(~ours), some))
            if not some.where(~theirs).isEmpty():
                found = found.unionByName(pairs(rows.where(ours), some.where(~theirs)))
        top = top_k(found.withColumn("score", F.round("score", 6)), k)
        return top.where(keep) if limit_first and keep is not None else top

    found = [one(queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == i)) for i in range(parts)] if parts > 1 else [one(queries)]
    return reduce(DataFrame.unionByName, found)


def stats(rows: DataFrame, vector_col: str) -> DataFrame:
    return rows.agg(F.max(F.size(vector_col)).alias("dim"), F.count("*").alias("n"), F.round(F.avg(norm(F.col(vector_col))), 6).alias("mean_norm"))


def ivf_search(rows: DataFrame, queries: DataFrame, k: int = 10, lists: int = 100, probe: int = 10, seed: int = 5, iterations: int = 8) -> DataFrame:
    """rows(doc, v), queries(query, qv) -> query, doc, score, rank, by inner product within the `probe` nearest of `lists` k-means cells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    lists = max(1, min(lists, rows.count()))
    feats = rows.withColumn("f", array_to_vector(F.transform("v", lambda x: x.cast("double"))))
    model = KMeans(k=lists, maxIter=iterations, seed=seed, featuresCol="f", predictionCol="cell").fit(feats)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    table = F.array(*(F.struct(F.lit(i).alias("cell"), F.array(*map(F.lit, c)).alias("c")) for i, c in enumerate(centres)))
    near = F.slice(F.array_sort(F.transform(table, lambda t: F.struct(squared_distance(F.col("qv"), t["c"]).alias("d"), t["cell"].alias("cell")))), 1, min(probe, len(centres)))
    cells = model.transform(feats).select("doc", "v", "cell")
    asked = queries.select("query", "qv", F.explode(F.transform(near, lambda x: x["cell"])).alias("cell"))
    return top_k(cells.join(asked, "cell").select("query", "doc", F.round(dot(F.col("v"), F.col("qv")), 6).alias("score")), k)
