"""Ranked lists: rows (query, doc, score, rank, retriever) of several retrievers, merged, fused, deduplicated, reranked."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.operators.sparse import top_k

RRF_K = 60


def label(lists: dict[str, DataFrame]) -> DataFrame:
    """One table of all lists, with retriever and its position."""
    named = [d.select("query", "doc", F.col("score").cast("double").alias("score"), "rank", F.lit(n).alias("retriever"), F.lit(i).alias("position")) for i, (n, d) in enumerate(lists.items())]
    return reduce(DataFrame.unionByName, named)


def _weight(weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("retriever")), F.lit(0.0))


def rrf(hits: DataFrame, k: int, weights: dict[str, float] | None = None, constant: int = RRF_K) -> DataFrame:
    """sum of weight / (constant + rank) by document: a union and one aggregation instead of full outer joins."""
    fused = hits.groupBy("query", "doc").agg(F.round(F.sum(_weight(weights) / (constant + F.col("rank"))), 6).alias("score"))
    return top_k(fused, k)


def weighted_sum(hits: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of min-max scores; missing: 0; equal scores of a list divide by 1."""
    w = Window.partitionBy("query", "retriever")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    scaled = hits.withColumn("s", (F.col("score") - low) / F.when(span == 0, F.lit(1.0)).otherwise(span))
    return top_k(scaled.groupBy("query", "doc").agg(F.round(F.sum(_weight(weights) * F.col("s")), 6).alias("score")), k)


def interleave(hits: DataFrame, k: int) -> DataFrame:
    """By rank, then list; a document's first place counts."""
    first = Window.partitionBy("query", "doc").orderBy("rank", "position")
    kept = hits.withColumn("n", F.row_number().over(first)).where("n = 1")
    order = Window.partitionBy("query").orderBy(F.col("rank").alias("r"), "position")
    return kept.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).select("query", "doc", "score", F.col("new_rank").alias("rank"), "retriever")


def dedup(hits: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the hit with the best score, in the place of the key's first."""
    w = Window.partitionBy("query", *key)
    best = hits.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "rank", "doc"))).withColumn("place", F.min("rank").over(w)).where("n = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("place", "doc"))).drop("n", "place")


def merge_queries(hits: DataFrame, k: int) -> DataFrame:
    """hits(query, variant, weight, doc, score, rank): scores times the variant's weight; a document's first seen variant counts."""
    first = Window.partitionBy("query", "doc").orderBy("variant", "rank")
    kept = hits.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("score", F.round(F.col("score") * F.col("weight"), 6))
    return top_k(kept.select("query", "doc", "score"), k)


def threshold(hits: DataFrame, min_score: float = 0.0, predicate: Column | None = None) -> DataFrame:
    out = hits.where(F.col("score") >= min_score) if min_score > 0 else hits
    return out.where(predicate) if predicate is not None else out


def overlap_score(query_tokens: Column, doc_tokens: Column) -> Column:
    """The share of the query's distinct tokens that the document has; the scorer used where no model is at hand."""
    q = F.array_distinct(query_tokens)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, doc_tokens)) / F.size(q)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, scorer: Column, in_k: int, out_k: int) -> DataFrame:
    """The first in_k of each query scored anew, min-max scaled within the query, the best out_k kept."""
    w = Window.partitionBy("query")
    scored = hits.where(F.col("rank") <= in_k).withColumn("raw", scorer)
    low, span = F.min("raw").over(w), F.max("raw").over(w) - F.min("raw").over(w)
    scored = scored.withColumn("score", F.round((F.col("raw") - low) / F.when(span == 0, F.lit(1.0)).otherwise(span), 6))
    return top_k(scored.drop("rank", "raw"), out_k)


def pair_text(path: Column, name: Column, kind: Column, imports: Column, content: Column, longest: int = 512) -> Column:
    """What a pair scorer reads of a chunk: where it is, its kind, its first five imports and its content's beginning."""
    most = longest - 100
    cut = F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), path, F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(", Name: "), name)).otherwise(F.lit(""))),
        F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("Type: "), kind)),
        F.when(F.size(imports) > 0, F.concat(F.lit("Imports: "), F.array_join(F.slice(imports, 1, 5), ", "))),
        F.concat(F.lit("Content:\n"), cut),
    )


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]], query: Column, text: Column, batch: int = 32) -> Column:
    """A score by a model of (query, text) pairs: `load` is called once in a worker, its result with lists of at most `batch` pairs."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = load()
        for q, t in parts:
            q, t = q.tolist(), t.tolist()
            yield pd.Series([x for at in range(0, len(q), batch) for x in score(q[at : at + batch], t[at : at + batch])], dtype=float)

    return run(query, text)


def rerank_by_table(hits: DataFrame, scores: DataFrame, in_k: int = 10) -> DataFrame:
    """hits, scores(query, doc, points of 0 to 10): the first in_k by points / 10, those without points by their old score; the rest as they are behind them."""
    first = hits.where(F.col("rank") <= in_k).join(scores, ["query", "doc"], "left").withColumn("score", F.coalesce(F.col("points") / 10, F.col("score"))).drop("points")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return first.withColumn("rank", F.row_number().over(w)).unionByName(hits.where(F.col("rank") > in_k))


def interleave_variants(hits: DataFrame, k: int) -> DataFrame:
    """hits(query, variant, doc, score, rank): by rank, then variant; a document's first place counts."""
    return interleave(hits.withColumn("position", F.col("variant")).withColumn("retriever", F.col("variant").cast("string")), k)


def normalized(weights: dict[str, float]) -> dict[str, float]:
    """Weights that sum to 1."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights sum to 0")
    return {k: w / total for k, w in weights.items()}


def hybrid(lists: dict[str, DataFrame], k: int, weights: dict[str, float] | None = None, how: str = "rrf") -> DataFrame:
    """Fused lists (each of about 3k hits) with every list's score as <name>_score: query, doc, score, rank, ..."""
    hits = label(lists)
    weights = normalized(weights or dict.fromkeys(lists, 1.0))
    fused = {"rrf": rrf, "weighted": weighted_sum}[how](hits, k, weights)
    each = hits.groupBy("query", "doc").agg(*(F.max(F.when(F.col("retriever") == n, F.col("score"))).alias(f"{n}_score") for n in lists))
    return fused.join(each, ["query", "doc"])


def field_boost(hits: DataFrame, names: DataFrame, queries: DataFrame, k: int, name: float = 3.0, imports: float = 0.5) -> DataFrame:
    """hits, names(doc, name, imports array), queries(query, text): the score times `name` if the name holds the query, times
    `imports` if the imports hold one of its words; ranked again."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    both = hits.drop("rank").join(names, "doc").join(queries.select("query", "text"), "query")
    held = low(F.array_join("imports", " "))
    some = F.exists(F.filter(F.split(low(F.col("text")), r"\s+"), lambda w: w != ""), lambda w: F.contains(held, w))
    factor = F.when((low(F.col("name")) != "") & F.contains(low(F.col("name")), low(F.col("text"))), name).otherwise(1.0) * F.when((F.size("imports") > 0) & some, imports).otherwise(1.0)
    return top_k(both.select("query", "doc", F.round(F.col("score") * factor, 6).alias("score")), k)


def cascade(hits: DataFrame, steps: list[tuple[Column, int, int]]) -> DataFrame:
    for scorer, in_k, out_k in steps:
        hits = rerank(hits, scorer, in_k, out_k)
    return hits
