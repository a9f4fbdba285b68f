"""Tests of ranks and variances, tails of distributions, graph search, followed files, table functions: against plain versions."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import tables as table_functions
from spindrift.operators import dense, significance, vector_graph
from spindrift.sources import tailing
from spindrift.tables import release

# Tails


def test_tails(spark):
    z = [-9.0, -3.2, -1.0, -0.1, 0.0, 0.5, 1.96, 7.5]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(significance.normal_cdf(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in z], rel=1e-12)
    g = [0.5, 1.0, 2.5, 40.0, 5000.5]
    got = [r.p for r in spark.createDataFrame([(v,) for v in g], "x double").select(significance.log_gamma(F.col("x")).alias("p")).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in g], rel=1e-12, abs=1e-12)
    # Known values of the F, t and studentized range distributions.
    one = spark.range(1)
    f = lambda *a: one.select(significance.f_tail(*map(F.lit, a))).first()[0]
    assert f(4.0, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(2), abs=1e-10) and f(1.0, 7, 7) == pytest.approx(0.5, abs=1e-10) and f(0.0, 3, 4) == 1
    assert f(3.0, 2, 10) == pytest.approx((1 + 2 * 3 / 10) ** -5, abs=1e-10) and f(2.0, 2, 100_000) == pytest.approx((1 + 4 / 100_000) ** -50_000, abs=1e-9)
    q = lambda *a: one.select(significance.studentized_range_tail(*map(F.lit, a))).first()[0]
    assert q(3.877, 3, 10) == pytest.approx(0.05, abs=2e-4) and q(3.633, 4, 1_000_000) == pytest.approx(0.05, abs=2e-4)
    t = one.select(significance.t_tails(F.lit(2.5), F.lit(12))).first()[0]
    assert q(2.5 * math.sqrt(2), 2, 12) == pytest.approx(t, abs=1e-6)


# Ranks


def ranks(values):
    order = sorted(values)
    return [(order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in values]


def test_rank_tests(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(x), float(x + d)) for g in ("a", None) for x, d in zip(rng.integers(0, 9, 60), rng.integers(-4, 6, 60), strict=True)]
    rows += [("flat", 1.0, 1.0)] * 5 + [("a", None, 1.0), ("a", float("nan"), 1.0)] + [("two", 1.0, 2.0), ("two", 2.0, 1.0)] + [("line", float(i), 3.0 * i) for i in range(9)]
    table = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in significance.wilcoxon(table, ["g"]).collect()}
    rho = {r.g: r for r in significance.spearman(table, ["g"]).collect()}
    for g in ("a", None):
        mine = [(x, y) for k, x, y in rows if k == g and x is not None and x == x]
        d = [x - y for x, y in mine if x != y]
        r = ranks([abs(v) for v in d])
        up = sum(a for a, v in zip(r, d, strict=True) if v > 0)
        n = len(d)
        ties = sum(len(list(e)) ** 3 for _, e in itertools.groupby(sorted(map(abs, d)))) - n
        z = (up - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        assert (got[g].n, got[g].w_plus, got[g].w_minus) == (n, up, n * (n + 1) / 2 - up)
        assert got[g].z == pytest.approx(z, abs=1e-6) and got[g].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)
        want = np.corrcoef(ranks([x for x, _ in mine]), ranks([y for _, y in mine]))[0, 1]
        assert rho[g].n == len(mine) and rho[g].rho == pytest.approx(want, abs=1e-6)
    assert (got["flat"].n, got["flat"].z, got["flat"].p) == (0, None, None)
    assert rho["flat"].rho is None and rho["two"].rho is None and (rho["line"].rho, rho["line"].t, rho["line"].p) == (1.0, None, None)
    assert significance.wilcoxon(table.limit(0), ["g"]).count() == 0


def test_midranks_over_many_partitions(spark):
    values = [int(v) for v in np.random.default_rng(5).integers(0, 5000, 20_000)] + [7] * 9000
    counts = spark.createDataFrame([(v,) for v in values], "v int").groupBy("v").agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
    got = {r.v: r["rank"] for r in significance.midranks(counts, ["g"], "v").collect()}
    order = np.sort(values)
    assert got == {v: (np.searchsorted(order, v, "left") + 1 + np.searchsorted(order, v, "right")) / 2 for v in set(values)}


def test_variances(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(0, 1, 30), "b": rng.normal(1, 1, 20), None: rng.normal(0.2, 1, 25)}
    rows = [(1, g, float(v)) for g, vs in groups.items() for v in vs] + [(2, "a", 1.0), (2, "a", 2.0), (3, "a", 1.0), (3, "b", 1.0), (3, "b", None)]
    table = spark.createDataFrame(rows, "part int, group string, value double")
    got = {r.part: r for r in significance.anova(table, ["part"]).collect()}
    every = np.concatenate(list(groups.values()))
    between = sum(len(v) * (v.mean() - every.mean()) ** 2 for v in groups.values()) / 2
    within = sum(((v - v.mean()) ** 2).sum() for v in groups.values()) / (75 - 3)
    assert (got[1].groups, got[1].n) == (3, 75) and got[1].f == pytest.approx(between / within, abs=1e-6) and 0 < got[1].p < 1
    assert got[2].f is None and got[3].f is None and got[3].n == 2
    pairs = {(r.a, r.b): r for r in significance.tukey(table.where("part = 1"), []).collect()}
    assert set(pairs) == {("a", "b")}
    q = abs(groups["a"].mean() - groups["b"].mean()) / math.sqrt(within / 2 * (1 / 30 + 1 / 20))
    assert pairs["a", "b"].q == pytest.approx(q, abs=1e-6)


# Graph search


def test_graph_recall_on_all_queries(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as doc", "embedding as v")
    odd = spark.createDataFrame([(90_000, None), (90_001, [])], rows.schema)
    asked = rows.selectExpr("doc as query", "v as qv")
    graph = vector_graph.build(rows.unionByName(odd), degree=16, rounds=3)
    found = vector_graph.search(rows.unionByName(odd), graph, asked, 10, beam=24)
    got = {(r.query, r.doc): r for r in found.collect()}
    want = {(r.query, r.doc): r.score for r in dense.search(rows, asked, 10).collect()}
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(got[k].score == pytest.approx(want[k], abs=1e-6) for k in got.keys() & want.keys())
    n = rows.count()
    assert sum(r.scored for r in got.values() if r["rank"] == 1) < n * n
    release(found, graph)
    assert vector_graph.search(rows.limit(0), vector_graph.build(rows.limit(0), rounds=1), asked).count() == 0


# Followed files


def _line(i, end="\n"):
    return json.dumps({"instance_id": f"i{i}", "model_patch": "p" * (i % 50), "model_name_or_path": "m"}) + end


def test_followed_files(spark, tmp_path):
    spark.dataSource.register(tailing.Predictions)
    folder = tmp_path / "in"
    folder.mkdir()
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    (folder / "_SUCCESS").write_text("")
    a.write_text("".join(map(_line, range(300))) + "not json\n[1]\n\n" + '{"instance_id": 5}\n')

    def run():
        stream = spark.readStream.format("predictions").option("rangeBytes", 700).load(str(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted(r.instance_id for r in spark.read.schema(tailing.SCHEMA).parquet(f"{tmp_path}/out").collect())

    first = sorted([f"i{i}" for i in range(300)] + ["5"])
    assert run() == first
    b.write_text(_line(400) + _line(401, ""))
    with a.open("a") as f:
        f.write(_line(301) + '{"instance_id": "hal')
    second = sorted([*first, "i400", "i301"])
    assert run() == second and run() == second
    with a.open("a") as f:
        f.write('f"}\n')
    with b.open("a") as f:
        f.write("\n")
    assert run() == sorted([*second, "half", "i401"])
    batch = spark.read.format("predictions").option("rangeBytes", 111).load(str(folder))
    assert sorted(r.instance_id for r in batch.collect()) == run()
    assert batch.where("instance_id = 'i49'").first().model_patch == "p" * 49
    (tmp_path / "none").mkdir()
    assert spark.read.format("predictions").load(str(tmp_path / "none")).count() == 0


# Table functions


def test_table_functions(spark):
    table_functions.register(spark, "halves", table_functions.chunk_function(lambda t: [(0, len(t) // 2), (len(t) // 2, len(t))]))
    d = spark.createDataFrame([(1, "abcd"), (2, ""), (3, None)], "id int, t string")
    got = spark.sql("SELECT id, chunk, content FROM {d}, LATERAL halves(t) ORDER BY id, chunk", d=d).collect()
    assert [tuple(r) for r in got] == [(1, 0, "ab"), (1, 1, "cd"), (2, 0, ""), (2, 1, ""), (3, 0, ""), (3, 1, "")]
    table_functions.register(spark, "parts", table_functions.section_function(lambda x: x.startswith("#"), 3))
    lines = spark.createDataFrame([(7, i, x) for i, x in enumerate(["pre", "# a", "b", "c", "d", "# e"], 1)] + [(8, 1, None), (None, 1, "x")], "key long, line int, content string")
    got = spark.sql("SELECT * FROM parts(TABLE(SELECT * FROM {l}) PARTITION BY key ORDER BY line) ORDER BY key, first", l=lines).collect()
    assert [tuple(r) for r in got] == [(None, 1, 1, "x", 1), (7, 1, 1, "pre", 3), (7, 2, 4, "# a", 5), (7, 5, 5, "d", 1), (7, 6, 6, "# e", 3), (8, 1, 1, "", 0)]
