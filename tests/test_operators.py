import json

import pytest
from pyspark.sql import functions as F

from spindrift import registry
from spindrift.functions import text as T
from spindrift.operators import chunking, context, explore, fusion, ingest, metrics, querygen, report
from spindrift.sources import records
from spindrift.streaming import progress


def one(spark, expr, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())).select(expr.alias("x")).first()["x"]


def test_code_tokens(spark):
    assert one(spark, T.code_tokens(F.col("s")), s="getHTTPResponse foo_barBaz x 7 42 a==b ParseJSON") == ["get", "http", "response", "foo_bar", "baz", "7", "42", "==", "parse", "json"]


def test_windows_end_at_the_end(spark):
    assert [tuple(w) for w in one(spark, T.windows(F.col("s"), 4, 1), s="abcdefghij")] == [(0, "abcd"), (3, "defg"), (6, "ghij")]
    assert one(spark, T.windows(F.col("s"), 4, 1), s="") == []
    assert chunking.boundary_cuts("a" * 2500, 1000, 200)[-1][1] == 2500


DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n def f():\n-    return 1\n+    return 2\n \n@@ -10 +10 @@\n+class New:\n"


def test_diffs(spark):
    assert one(spark, T.diff_files(F.col("p")), p=DIFF) == ["x.py"]
    assert one(spark, T.diff_names(F.col("p")), p=DIFF) == ["New"]
    assert one(spark, T.diff_lines(F.col("p")), p=DIFF) == [2, 10]
    assert one(spark, T.diff_lines(F.col("p"), compat=True), p=DIFF) == [3, 10]
    assert one(spark, T.diff_files(F.col("p")), p="") == []
    assert one(spark, metrics.patch_syntax_ok(F.col("p")), p=DIFF) and one(spark, metrics.patch_format_ok(F.col("p")), p=DIFF)


@pytest.mark.parametrize(("text", "want"), [(None, []), ("a\n\n b ", ["a", "b"]), ('["t::a", "t::b"]', ["t::a", "t::b"])])
def test_test_list(spark, text, want):
    assert one(spark, T.test_list(F.col("s").cast("string")), s=text) == want


def test_resolved_by_tests(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert spark.range(1).select(metrics.resolved_by_tests(a("f"), a("p"), a("f", "p"), a()).alias("x")).first().x
    assert not spark.range(1).select(metrics.resolved_by_tests(a("f"), a("p"), a("p"), a("f")).alias("x")).first().x


def test_fusion_symmetry_and_budget(spark):
    rows = [(1, "a", 3.0, 1, "x", 0), (1, "b", 2.0, 2, "x", 0), (1, "b", 9.0, 1, "y", 1), (1, "c", 9.0, 2, "y", 1)]
    hits = spark.createDataFrame(rows, "query int, doc string, score double, rank int, retriever string, position int")
    assert [r.doc for r in fusion.rrf(hits, 3).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r.doc for r in fusion.interleave(hits, 3).orderBy("rank").collect()] == ["a", "b", "c"]
    scores = {r.doc: r.score for r in fusion.weighted_sum(hits, 3).collect()}
    assert scores == {"a": 1.0, "b": 0.0, "c": 0.0}
    ctx = spark.createDataFrame([(1, 1, "a" * 4000, "file_content", 2.0), (1, 2, "b" * 4000, "file_content", 1.0)], "query int, doc int, content string, context_type string, score double")
    out = context.trim_to_budget(ctx, 1500).orderBy("doc").collect()
    assert [r.tokens for r in out] == [1000, 500] and [r.truncated for r in out] == [False, True]


def test_metrics_bounds(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    r = spark.range(1).select(metrics.recall_at(a(1, 2), a(2, 3, 1), 1).alias("r1"), metrics.recall_at(a(1, 2), a(2, 3, 1), 3).alias("r3"), metrics.mrr(a(1, 2), a(2, 3, 1)).alias("m"), metrics.top_k_accuracy(a(1), a(2, 1), 1).alias("t")).first()
    assert (r.r1, r.r3, r.t) == (50.0, 100.0, False) and abs(r.m - (1 + 1 / 3) / 2) < 1e-12
    attempts = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "i int, n int, ok boolean")
    got = {r.i: r for r in metrics.pass_at_k(attempts, "i", "n", "ok", (1, 2)).collect()}
    assert (got[1].pass_at_1, got[1].pass_at_2, got[2].pass_at_2) == (0, 1, None)
    assert one(spark, metrics.price(F.col("m"), 0), m="gpt-4o-mini-x") == 0.00015
    assert one(spark, metrics.price(F.col("m"), 0, True), m="gpt-4o-mini-x") == 0.03


def test_wilson_contains_rate(spark):
    rows = spark.createDataFrame([("a", i, i < 3, True, 1.0, 1) for i in range(10)] + [("b", 1, False, False, 1.0, 1)], "method string, instance int, resolved boolean, applied boolean, seconds double, tokens int")
    for r in report.wilson(rows).collect():
        assert r.lower <= r.rate <= r.upper
    assert report.markdown("t", {"x": report.compare(rows)}).startswith("# t")


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert explore.closure(edges).count() == 9


def test_parsers(spark):
    out = "t.py::a PASSED\nt.py::b FAILED\n=== 1 failed, 1 passed ==="
    assert [tuple(x) for x in one(spark, explore.test_outcomes(F.col("o")), o=out)] == [("t.py::a", "PASSED"), ("t.py::b", "FAILED")]
    assert [x["code"] for x in one(spark, explore.lint_rows(F.col("o")), o="a.py:1:2: E501 too long")] == ["E501"]
    assert one(spark, explore.repo_of_url(F.col("u")), u="https://host/owner/name.git") == "owner/name"


def test_query_generation(spark):
    text = 'Fix parse_data: raises ValueError "decode failed badly" in module.func. How to handle getItem?'
    got = {r.query_type: r.query_text for r in querygen.generate(spark.createDataFrame([(1, text)], "item_id int, text string"), most=20).collect()}
    assert got["error_source"] == "raise ValueError" and got["function_search"] == "def parse_data"
    assert got["action_keywords"].startswith("Fix ")


def test_sources(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("instance_id string, model_patch string, model_name_or_path string")
    rows = [{"instance_id": "a", "model_patch": "1"}, {"instance_id": "a", "model_patch": "2"}, {"instance_id": "b", "model_patch": "3"}]
    p = tmp_path / "p.jsonl"
    p.write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n")
    assert records.read_jsonl(spark, str(p), schema).count() == 3
    got = {r.instance_id: r.model_patch for r in records.read_predictions(spark, str(p)).where("instance_id is not null").collect()}
    assert got == {"a": "2", "b": "3"}
    q = tmp_path / "p.json"
    q.write_text(json.dumps({"x": {"model_patch": "9"}}))
    assert records.read_json(spark, str(q), schema).first().instance_id == "x"
    with pytest.raises(ValueError, match="unknown"):
        records.read_records(spark, "x.csv", schema)
    repo = tmp_path / "repo" / "pkg"
    repo.mkdir(parents=True)
    (repo / "a.py").write_text("x = 1\n")
    (repo / "b.txt").write_text("no")
    assert [r.path for r in records.read_repository(spark, str(tmp_path / "repo")).collect()] == ["pkg/a.py"]
    assert records.substitute({"k": ["${A}", "${B:-d}"]}, {"A": "1"}) == {"k": ["1", "d"]}


def test_ingest(spark):
    raw = spark.createDataFrame([("o__r-1", "o/r", "c", "p", "", DIFF, "a\nb", None)], "instance_id string, repo string, base_commit string, problem_statement string, test_patch string, patch string, FAIL_TO_PASS string, PASS_TO_PASS string")
    n = ingest.normalize(raw)
    assert n.first().failed_tests == ["a", "b"] and n.first().modified_files == ["x.py"]
    assert ingest.invalid(n, ingest.instance_rules(), "instance_id").count() == 0
    assert ingest.filter_repos(n, ["r"]).count() == ingest.filter_repos(n, ["o"]).count() == 1


def test_stream_append_equals_batch(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = progress.read_files(spark, f"{sf}/events.parquet*", schema)
    for _ in range(2):  # a restart adds nothing
        progress.append_checkpointed(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_registry():
    registry.register("chunker", "own-test")(chunking.line_chunks)
    with pytest.raises(ValueError, match="already"):
        registry.register("chunker", "own-test")(chunking.line_chunks)
    assert registry.get("chunker", "own-test") is chunking.line_chunks


def test_file_scores_count_the_path(spark):
    files = spark.createDataFrame([("src/Parser.py", "parser here\nand a parser"), ("src/b.py", "parser\nparser\nx"), ("src/c.py", "none")], "doc string, text string")
    words = spark.createDataFrame([(1, "PARSER"), (1, "parser")], "query int, word string")
    assert [(r.doc, r.score) for r in explore.file_scores(files, words).orderBy("rank").collect()] == [("src/Parser.py", 3.0), ("src/b.py", 2.0)]
    assert [(r.doc, r.score) for r in explore.file_scores(files, words, layered=True).orderBy("rank").collect()] == [("src/Parser.py", 7.0), ("src/b.py", 3.0)]
    tests = spark.createDataFrame([(1, "pkg.B_py.c.py")], "query int, test string")
    assert explore.file_scores(files, words, tests).where("doc = 'src/c.py'").count() == 0
