"""Searches by blocks against plain computations, with blocks so small that each task has many."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import blocks, dense, sparse, vector_index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounding_is_sparks(spark):
    x = [0.1234565, 0.1234575, 2.5e-7, 5e-7, 1e-6, -0.1234565, 7.0000005, 123456.7890125, 0.0, -5e-7, 3.1]
    want = [r.r for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 6).alias("r")).collect()]
    assert (blocks.micro(np.array(x)) / 1e6).tolist() == want
    assert blocks.micro(np.array([1e16]))[0] == float(Decimal("1e16").quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6))


def test_best_takes_ties_by_place():
    group, score, place = np.array([0, 1, 0, 0, 1]), np.array([1.0, 2.0, 1.0 + 1e-9, 3.0, 2.5]), np.array([0, 1, 2, 3, 4])
    assert sorted(blocks.best(group, score, place, 2).tolist()) == [0, 1, 3, 4]
    assert len(blocks.best(np.empty(0, int), np.empty(0), np.empty(0), 3)) == 0
    assert blocks.places(pa.array(["b", None, "a"])).tolist() == [2, 0, 1]


def test_search_by_blocks_equals_pairs(spark, sf, monkeypatch):
    """Also with equal texts, a null id, an id in two rows, and a query without a known term; no pair is left in the result's plan."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 40").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")).unionByName(spark.createDataFrame([(None, "tok zebra_stripe"), (3, "zebra_stripe twice")], "doc_id long, text string"))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame([(-1, "zebra_stripe"), (-2, "!"), (-3, "nowhere_found")], "item_id long, text string"))
    index = sparse.build(docs)
    terms = asked.select(F.col("item_id").alias("query"), F.explode(T.code_tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    hits = index.postings.join(index.terms.join(terms, "term"), "term").crossJoin(index.stats.select("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    want = sparse.top_k(hits.groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0"), 5)
    want = sorted(map(str, want.select("query", "doc", "score", "rank").collect()))
    got = sparse.search_index(index, asked, 5)
    assert "Exchange" not in plan(got) and sorted(map(str, got.select("query", "doc", "score", "rank").collect())) == want
    monkeypatch.setattr(blocks, "SCORES", 40)
    monkeypatch.setattr(sparse, "PASS_ROWS", 500)
    assert sorted(map(str, sparse.search_index(index, asked, 5).select("query", "doc", "score", "rank").collect())) == want


def test_scores_go_on_over_batches():
    weights = blocks.Weights(np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([1.0, 2.0, 4.0]), 2, 2)
    held = blocks.Scores(weights, 1, 1)
    rows = [("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 3.0), ("c", 1, 1.0), ("c", 0, 1.0)]
    for cuts in ([5], [1, 1, 1, 1, 1], [3, 2], [4, 1]):
        found, at = [], 0
        for n in cuts:
            some = rows[at : at + n]
            found += held.add(pa.array([r[0] for r in some]), np.array([r[1] for r in some]), np.array([r[2] for r in some]))
            at += n
        found += held.flush()
        got = {(d, int(q)): s for ds, qs, ss in found for d, q, s in zip(ds.to_pylist(), qs, ss, strict=True)}
        assert got == {("a", 0): 1.0, ("a", 1): 6.0, ("b", 0): 3.0, ("b", 1): 6.0, ("c", 0): 1.0, ("c", 1): 6.0}


def test_rows_of_tokens_are_small(spark):
    """A row of a token doesn't carry its document's whole array."""
    rows = sparse.token_rows(spark.createDataFrame([(1, "ab cd ab")], "doc_id long, text string"), "doc_id", {"text": 1})
    generate = next(x for x in plan(rows).splitlines() if "Generate inline" in x)
    assert ", [doc#" in generate and "_0#" not in generate.split(", [doc#")[1]
    assert sorted(map(tuple, rows.collect())) == [(1, 3, "ab", 1), (1, 3, "ab", 1), (1, 3, "cd", 1)]


def test_tokens_at_capitals(spark):
    texts = ["7Abc 7aBc éABCé xİKK aB1Cd__E _A A_ A1B2 AbC+=D-e", "HTTPServerX2Y _x _ __ Éa aÉb ABCdefGHI", None]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string").orderBy("i").select(T.code_tokens(F.col("s")).alias("t")).collect()]
    assert got == [["7", "abc", "7", "bc", "abc", "kk", "b1", "cd__", "a_", "a1", "b2", "ab", "+="], ["http", "server", "x2", "_x", "__", "ab", "cdef", "ghi"], []]


def test_vectors_meet_as_matrices(spark):
    """Equal vectors, a null and a ragged one, in both measures; scores are those of the pairs, and no pair is in the plan but of odd rows."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 3]) for i in range(300)] + [(1000 + i, [0.5] * 4) for i in range(50)] + [(2000, None), (2001, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "doc long, v array<float>")
    asked = table.where("doc % 7 = 0 and doc < 2000").selectExpr("doc as query", "v as qv")
    for metric in ("ip", "l2"):
        score = dense.dot(F.col("v"), F.col("qv")) if metric == "ip" else -dense.squared_distance(F.col("v"), F.col("qv"))
        want = sparse.top_k(table.crossJoin(asked).select("query", "doc", F.round(score, 6).alias("score")), 6)
        got = dense.search(table, asked, 6, metric)
        assert "MapInArrow" in plan(got)
        assert sorted(map(tuple, got.select("query", "doc", "score", "rank").collect())) == sorted(map(tuple, want.collect()))


def test_index_ties_by_rounded_score(spark, tmp_path):
    """Rows whose scores differ past the sixth digit only are in order of the id, whatever cell they are in."""
    rows = spark.createDataFrame([(i, [1.0 + i * 1e-9, 0.0]) for i in range(40)] + [(100 + i, [-1.0, float(i)]) for i in range(40)], "doc long, v array<double>")
    vector_index.build(rows, f"file://{tmp_path}/i", cells=6)
    index = vector_index.VectorIndex.load(spark, f"file://{tmp_path}/i")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "query long, qv array<double>")
    for metric in ("ip", "l2"):
        got = vector_index.search(index, asked, 3, probe=1, metric=metric, exact=True)
        assert "Exchange" not in plan(got)
        assert sorted((r["query"], r["rank"], r["doc"]) for r in got.collect()) == [(q, i + 1, i) for q in (1, 2) for i in range(3)]


def test_windows_share_a_worker(spark, sf):
    from spindrift.operators import tokens
    from spindrift.plans import retrieval

    got = retrieval.token_windows(spark, sf)
    assert plan(got).count("ArrowEvalPython [") == 1
    vocabulary = tokens.Vocabulary(tuple((bytes([i]), i) for i in range(256)), r"\w+|\W")
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "ab cd", "é" * 7, *["x" * n for n in range(1, 1200)]])], "i int, s string").coalesce(1)
    both = texts.select("i", tokens.all_windows(F.col("s"), {"a": (3, 0), "b": (4, 2)}, vocabulary).alias("w"), tokens.windows(F.col("s"), 3, 0, vocabulary).alias("one")).orderBy("i").collect()
    assert len(both) == 1203 and all(r.w.a == r.one for r in both) and [r.one for r in both[:2]] == [[], []]
    assert [tuple(x) for x in both[2].w.b] == [(0, 4, 4), (2, 5, 3)]
