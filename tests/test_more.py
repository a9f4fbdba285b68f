import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift import __main__ as cli
from spindrift import library, registry, tables
from spindrift.functions import text as T
from spindrift.operators import chunking, context, dense, explore, fusion, holding, metrics, querygen, report, sparse
from spindrift.sources import records
from spindrift.streaming import progress


def one(spark, expr, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())).select(expr.alias("x")).first()["x"]


def test_closure_of_a_deep_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(None, 3), (5, None)], "child long, parent long")
    got = explore.closure(edges)
    assert got.count() == n * (n + 1) // 2 and got.where("ancestor - child <> depth").count() == 0
    short = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(0, 15), (20, 0)], "child long, parent long")
    rows = {(r.child, r.ancestor): r.depth for r in explore.closure(short).collect()}
    best = np.full((21, 21), 10**6)
    for a, b in [*((i, i + 1) for i in range(20)), (0, 15), (20, 0)]:
        best[a, b] = 1
    for k in range(21):
        best = np.minimum(best, best[:, [k]] + best[[k], :])
    assert rows == {(a, b): best[a, b] for a in range(21) for b in range(21) if best[a, b] < 10**6}
    assert explore.closure(edges.limit(0)).count() == 0


def test_lines_near_wide_and_empty_ranges(spark):
    rng = np.random.default_rng(3)
    ranges = [(int(k), int(a), int(a + w)) for k, a, w in zip(rng.integers(0, 5, 60), rng.integers(-50, 5000, 60), rng.integers(-9, 40, 60), strict=True)] + [(1, 0, 10**12), (2, -(10**12), -5)]
    gold = [(int(k), int(x)) for k, x in zip(rng.integers(0, 6, 300), rng.integers(-100, 6000, 300), strict=True)]
    got = {r.k: (r.gold_lines, r.hit_lines) for r in metrics.line_accuracy(spark.createDataFrame(gold, "k int, line long"), spark.createDataFrame(ranges, "k int, first long, last long"), "k").collect()}
    want = {}
    for k in {k for k, _ in gold}:
        ls = {x for j, x in gold if j == k}
        want[k] = (len(ls), sum(any(j == k and a - 3 <= x <= b + 3 for j, a, b in ranges) for x in ls))
    assert got == want
    assert metrics.line_accuracy(spark.createDataFrame(gold, "k int, line long"), spark.createDataFrame([], "k int, first long, last long"), "k").where("hit_lines > 0").count() == 0


def test_boundary_chunks_keep_ids(spark):
    ids = [2**53 + 1, 2**53 + 3, None]
    d = spark.createDataFrame([(i, "word " * 60) for i in ids] + [(1, None), (2, "")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in chunking.boundary_chunks(d).collect()} == set(ids)


def test_index_is_saved_and_found_again(spark, sf, tmp_path):
    docs, asked = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    index = sparse.build(docs)
    index.save(f"file://{tmp_path}/i")
    loaded = sparse.Index.load(spark, f"file://{tmp_path}/i")
    rows = lambda i: sorted(map(tuple, sparse.search_index(i, asked, 5).collect()))
    assert rows(index) == rows(loaded) and loaded.documents() == docs.count()
    tables.release(index.postings, index.terms, index.stats)
    empty = sparse.build(docs.limit(0))
    assert sparse.search_index(empty, asked).count() == 0


def test_hybrid_weights(spark):
    assert fusion.normalized({"a": 1, "b": 3}) == {"a": 0.25, "b": 0.75}
    with pytest.raises(ValueError, match="sum to 0"):
        fusion.normalized({"a": 0.0})
    a = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 1.0, 2)], "query int, doc int, score double, rank int")
    b = spark.createDataFrame([(1, 11, 9.0, 1)], "query int, doc int, score double, rank int")
    got = {r.doc: r for r in fusion.hybrid({"x": a, "y": b}, 5, how="weighted").collect()}
    assert (got[11].x_score, got[11].y_score, got[10].y_score) == (1.0, 9.0, None) and got[10].score == 0.5


def test_query_sets_of_any_size(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    asked = rows.where("doc < 40").select(F.col("doc").alias("query"), F.col("v").alias("qv"))
    whole = sorted(map(tuple, dense.search(rows, asked, 3).select("query", "doc", "score", "rank").collect()))
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 4000)
    assert sorted(map(tuple, dense.search(rows, asked, 3).select("query", "doc", "score", "rank").collect())) == whole


def test_line_hits_by_containment(spark):
    texts = {"a.py": "def parse_row(x):\n    return parseRow(x)\n# row", "b.py": "nothing here\nROWS and 'two words'\n", "c.py": "", "ab.py": "x y\nab"}
    words = ["row", "two words", "ab", "x", "parse_row(", "_"]
    files = spark.createDataFrame(list(texts.items()), "doc string, text string")
    keywords = spark.createDataFrame([(1, w) for w in words] + [(2, "ROW"), (2, "")], "query int, word string")
    want = {(q, d, w.lower(), n) for q, ws in ((1, words), (2, ["row"])) for d, t in texts.items() for w in ws if (n := sum(w.lower() in x for x in t.lower().split("\n")))}
    for at_once in (200, 1):
        assert {tuple(r) for r in explore.line_hits(files, keywords, at_once=at_once).collect()} == want


@pytest.mark.parametrize("layered", [False, True])
def test_file_scores_by_a_plain_computation(spark, layered):
    """Ids that come again, null ids and texts, short and repeated parts of test names, words of all kinds; in one pass and in several."""
    rng = np.random.default_rng(7)
    some = ["row", "parse_row", "rows", "é!", "a b", "x", "_", "été", "errors", "it's", "zz9"]
    texts = ["\n".join(" ".join(rng.choice(some, 3)) for _ in range(int(rng.integers(1, 5)))) for _ in range(60)]
    rows = [(f"src/{['Row', 'a_b', 'X'][i % 3]}_{i % 50}.py", None if i == 9 else t) for i, t in enumerate(texts)] + [(None, "row\nrow"), (None, "x"), ("", "")]
    words = [(1, "ROW"), (1, "row"), (1, "a b"), (2, "É!"), (2, "r"), (2, "it's"), (2, "row\nx"), (None, "Errors"), (None, ""), (3, None), (4, "_"), (4, "!")]
    tests = [(1, "pkg.A_.Row_1"), (2, "Row_1.Row_1.x"), (5, "A_.src.XX"), (5, None)]
    line, more, part = (1.5, 2.0, 1.5) if layered else (1.0, 0.5, 2.0)
    want = {}
    for doc, text in rows:
        path = (doc or "").lower()
        name = path.rpartition("/")[2].replace(".py", "") if layered else path
        for q, w in {(q, w.lower()) for q, w in words if w}:
            n = sum(w in x for x in text.lower().split("\n")) if text is not None else 0
            want[q, doc] = want.get((q, doc), 0) + n * (line + (more if doc is not None and w in name else 0))
        for q, p in ((q, p) for q, t in tests if t for p in t.split(".")):
            if (len(p) > 3 if layered else "_" in p or p[:1].isupper()) and doc is not None and p.lower() in path:
                want[q, doc] = want.get((q, doc), 0) + part
    files, asked = spark.createDataFrame(rows, "doc string, text string").repartition(3), spark.createDataFrame(words, "query int, word string")
    best = {}
    for (q, doc), v in sorted(((x for x in want.items() if x[1])), key=lambda x: (-x[1], x[0][1] is not None, x[0][1] or "")):
        best.setdefault(q, []).append((q, doc, v, len(best.get(q, [])) + 1))
    for at_once in (1 << 15, 1):
        got = explore.file_scores(files, asked, spark.createDataFrame(tests, "query int, test string"), layered=layered, at_once=at_once)
        assert sorted(map(tuple, got.collect()), key=str) == sorted((r for rs in best.values() for r in rs[:5]), key=str)


def test_file_scores_hand_on_the_best_of_a_batch(spark):
    files = spark.range(400).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("doc"), F.lit("row of rows\nrow").alias("text")).repartition(4)
    files = files.withColumns({"name": F.col("doc"), "path": F.col("doc"), "again": F.lit(False)})
    wanted = spark.createDataFrame([(q, "row", False) for q in range(3)], "query int, word string, tested boolean")
    found, _ = holding.best_files(files, wanted, 5, 1.0, 0.5, 2.0)
    assert found.count() == 4 * 3 * 5 and {r.score for r in found.collect()} == {2.0}
    none = explore.file_scores(files.select("doc", "text"), spark.createDataFrame([], "query int, word string"))
    assert none.collect() == [] and none.columns == ["query", "doc", "score", "rank"]


def test_line_hits_of_files_that_come_again(spark):
    files = spark.createDataFrame([("a", "row"), ("a", "row\nrow"), ("b", None)], "doc string, text string")
    hits = explore.line_hits(files, spark.createDataFrame([(1, "Row")], "query int, word string"))
    assert [tuple(r) for r in hits.collect()] == [(1, "a", "row", 3)]


def test_keywords_of_problems(spark):
    text = "MyClass fails in parse_row with 'bad input' File \"x/mod.py\" error; loader of ABC a_b"
    got = {v: one(spark, explore.problem_keywords(F.col("t"), v), t=text) for v in explore.MOST_KEYWORDS}
    assert got["refined"][:2] == ["MyClass", "ABC"] and "bad input" in got["refined"] and "a_b" in got["refined"]
    assert "File" in got["layered"] and "error" in got["layered"] and "fails" in got["stepwise"]
    traced = one(spark, explore.problem_keywords(F.col("t")), t='Traceback: File "a/b/mod_x.py", line 3')
    assert "mod_x" in traced


def test_texts_of_models_and_paths(spark):
    assert [one(spark, T.encoding_of(F.col("m")), m=m) for m in ("gpt-4o", "gpt-4o-2024", "gpt-5-mini", "unknown")] == ["o200k_base", "o200k_base", "cl100k_base", "cl100k_base"]
    p = "a/b/c.tar.GZ"
    assert [one(spark, f(F.col("p")), p=p) for f in (T.basename, T.stem, T.extension)] == ["c.tar.GZ", "c.tar", ".gz"]
    assert one(spark, T.relative(F.col("p"), "a/b/"), p=p) == "c.tar.GZ" and one(spark, T.extension(F.col("p")), p="x/.env") == ""
    assert one(spark, T.import_names(F.col("s")), s="import os\nx = 1\n  from a import b\ndef broken(") == ["import os", "from a import b"]
    assert one(spark, T.codebleu_tokens(F.col("s")), s='x = """a\nb""" # c\ny = "d e"') == ["x", "=", '"', '"', '"', '"', '"', '"', "y", "=", '"', '"']
    assert one(spark, T.patch_of(F.col("s")), s="nothing") is None


def test_whole_word_lists_mark_their_query(spark):
    got = [r.text for r in querygen.variants(spark.createDataFrame([(1, "the fix of parse_row")], "item_id int, text string")).orderBy("variant").collect()]
    assert got == ["the fix of parse_row", "fix parse_row", "the fix of parse_row"]


def test_prompt_sections(spark):
    problems = spark.createDataFrame([(1, "P", None, "E"), (2, "Q", "H", None)], "query int, text string, hints string, error string")
    blocks = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query int, place int, block string")
    got = {r.query: r.prompt for r in context.prompts(problems, blocks, feedback="error").collect()}
    assert got == {1: "# Problem\nP\n\n# Context\na\n\nb\n\n# What went wrong\nE", 2: "# Problem\nQ\n\n# Hints\nH"}


def test_reports(spark):
    df = spark.createDataFrame([(1, "a|b\nc", None)], "n int, s string, v double")
    assert "| 1 | a\\|b c |  |" in report.markdown("t", {"x": df})
    assert json.loads(report.as_json("t", {"x": df}))["tables"]["x"] == [{"n": 1, "s": "a|b\nc", "v": None}]
    with pytest.raises(ValueError, match="more than 3"):
        report.markdown("t", {"x": spark.range(5)}, most=3)
    assert one(spark, report.bonferroni(F.col("p"), 10), p=0.04) == pytest.approx(0.4) and one(spark, report.signal_to_noise(F.col("a"), F.col("b")), a=1, b=4) == 0.25
    whole = report.evaluation_summary(spark.createDataFrame([(True, True, 1.0, 2.0, {"f": 1.0}), (False, True, 0.0, 4.0, {})], "resolved boolean, applied boolean, codebleu double, seconds double, localization map<string,double>")).first()
    assert (whole.total, whole.resolution_rate, whole.localization) == (2, 50.0, {"f": 0.5})
    assert metrics.estimate(10, "gpt-4o-mini-x", 1000, 1000, 2, 3) == {"model": "gpt-4o-mini-x", "runs": 20, "cost_per_instance": pytest.approx(0.00225), "total_cost": pytest.approx(0.045), "prompt_tokens": 60000, "completion_tokens": 60000}


def test_files_of_a_repository(spark, tmp_path):
    repo = tmp_path / "r"
    for path, data in {"a/x.py": b"y = 1\nz\n", "a/b/caf.py": b"s = '\x93\xe9\x94'\n", "a/lat.py": b"s = '\xe9'\n", "test_x.py": b"t\n", "a/tests/q.py": b"q\n", "a/z.pyc.py": b"\x00\x01"}.items():
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_bytes(data)
    files = records.read_repository(spark, str(repo))
    got = {r.path: r.content for r in files.collect()}
    assert got == {"a/x.py": "y = 1\nz\n", "a/b/caf.py": "s = '“é”'\n", "a/lat.py": "s = 'é'\n"}
    assert {(r.kind, r.path) for r in records.listing(files).collect()} == {("folder", "a"), ("folder", "a/b"), *(("file", p) for p in got)}
    assert {r.path: r.lines for r in records.find(files, "a/*.py").collect()} == {"a/x.py": 3, "a/lat.py": 2}


def test_bad_records_are_kept_apart(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"instance_id": "a", "n": 1}\nnot json\n\n{"instance_id": "b"}\n')
    good, bad = records.read_checked(spark, str(p), StructType.fromDDL("instance_id string, n int"))
    assert sorted(map(tuple, good.collect()), key=str) == [("a", 1), ("b", None)] and [r.line for r in bad.collect()] == ["not json"]
    q = tmp_path / "p.json"
    q.write_text(json.dumps([{"instance_id": "x", "model_patch": "1"}, {"instance_id": "x", "model_patch": "2"}]))
    found = records.read_predictions(spark, str(q))
    assert [r.model_patch for r in records.prediction_of(found, "x").collect()] == ["2"]
    spark.range(4).write.parquet(str(tmp_path / "sets/whole/dev"))
    assert records.read_dataset(spark, "w", str(tmp_path / "sets"), {"w": "whole"}, "dev").count() == 4
    records.write_results_json(spark.createDataFrame([("m", {"a": 1})], "method string, r map<string,int>"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().method == "m"


def test_configuration():
    c = records.configured({"preset": "rag", "execution": {"workers": 9}})
    assert c["execution"] == {"workers": 9, "attempts": 3} and records.method_entries(c)["hybrid"] == {"weights": {"sparse": 0.3, "dense": 0.7}}
    assert records.method_entries({"methods": {"a": None, "b": {"k": 1}}}) == {"a": {}, "b": {"k": 1}} and "methods" in records.configured("full")
    with pytest.raises(KeyError, match="no preset"):
        records.configured("none")
    with pytest.raises(ValueError, match="without a name"):
        records.method_entries({"methods": [{"k": 1}]})


def test_stream_in_small_files(spark, sf, tmp_path):
    stream = progress.read_files(spark, f"{sf}/events.parquet*", spark.read.parquet(f"{sf}/events.parquet").schema)
    progress.checkpoint_every(stream, str(tmp_path / "o"), str(tmp_path / "c"), 100, "event_id").awaitTermination()
    out = spark.read.parquet(str(tmp_path / "o"))
    assert out.count() == 1000 and len(list((tmp_path / "o").rglob("part-*.parquet"))) >= 10


def test_library_and_command_line(spark, sf, tmp_path, capsys):
    assert registry.get("fusion", "rrf") is fusion.rrf and "bm25" in registry.names("indexer") and "files" in library.OWN["metric"]
    assert cli.main(["version"]) == 0 and cli.main(["init", str(tmp_path / "c.json")]) == 0 == cli.main(["list"]) and cli.main(["init", str(tmp_path / "c.json")]) == 1
    assert records.configured(json.loads((tmp_path / "c.json").read_text()))["methods"] == ["sparse"]
    assert cli.main(["estimate-cost", "10", "gpt-4"]) == 0 and '"runs": 10' in capsys.readouterr().out
    cli.main(["run", "corpus_stats", sf, str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().count()
    cli.main(["index", f"{sf}/documents.parquet", str(tmp_path / "index")])
    cli.main(["search", str(tmp_path / "index"), spark.read.parquet(f"{sf}/benchmark.parquet").first().text, "-k", "3"])
    assert len(capsys.readouterr().out.strip().split("\n")) == 3
    rows = spark.createDataFrame([(m, i, i % 2 == 0, True, 1.0, 5) for m in "ab" for i in range(6)], "method string, instance int, resolved boolean, applied boolean, seconds double, tokens int")
    rows.write.parquet(str(tmp_path / "results"))
    cli.main(["report", str(tmp_path / "results")])
    cli.main(["evaluate", str(tmp_path / "results"), "--json"])
    said = capsys.readouterr().out
    assert "# report" in said and '"resolution_rate": 50.0' in said
    with pytest.raises(SystemExit, match="no query"):
        cli.main(["run", "none", sf, str(tmp_path / "x")])


def test_a_cluster_needs_a_shared_folder(spark):
    class Far:
        master, applicationId = "yarn", "far"

    class Session:
        sparkContext, conf = Far(), spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            tables.scratch(Session())
    else:
        assert tables.scratch(Session()) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_running_sums_in_buckets(spark):
    from spindrift.operators.running import running_sums

    rng = np.random.default_rng(4)
    rows = [(["a", "b", None][int(rng.integers(0, 3))], int(t), None if t % 7 == 0 else int(rng.integers(0, 9))) for t in rng.permutation(300)]
    d = spark.createDataFrame(rows, "k string, t int, v int")
    whole = running_sums(d, ["k"], ["t"], {"s": F.col("v"), "n": F.lit(1)})
    parts = running_sums(d, ["k"], ["t"], {"s": F.col("v"), "n": F.lit(1)}, F.floor(F.col("t") / 20))
    assert parts.columns == whole.columns and sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)
    last = {r.k: r.s for r in whole.groupBy("k").agg(F.max_by("s", "t").alias("s")).collect()}
    assert last == {k: sum(v or 0 for j, _, v in rows if j == k) for k in ("a", "b", None)}


def test_running_queries_pass_over_nulls(spark, tmp_path):
    """As their SQL does: null times last, no sum before the first value, nulls not counted in a mean."""
    from compare import duck_rows, spark_rows

    from spindrift.plans import catalog

    at = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 6 == 5 else at + dt.timedelta(minutes=25 * (i // 2)), i, "a" if i % 2 else "b", None if i < 4 or i % 5 == 0 else float(20 * i), None if i < 6 or i % 7 == 0 else f'{{"k": {i}}}') for i in range(24)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "events.parquet")
    for name in ("cost_per_resolved", "running_progress", "running_apply_rate", "gather_stats"):
        assert spark_rows(catalog.QUERIES[name](spark, str(tmp_path))) == duck_rows(catalog.ORACLES[name], str(tmp_path)), name


def test_experiments_below_a_folder(spark, tmp_path):
    for name, resolved in (("one", True), ("two", False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "results.json").write_text(json.dumps({"m": {"results": [{"instance_id": "a", "resolved": resolved}]}}))
    got = records.read_experiments(spark, str(tmp_path), "struct<results:array<struct<instance_id:string,resolved:boolean>>>")
    assert {(r.experiment, r.method, r.record.results[0].resolved) for r in got.collect()} == {("one", "m", True), ("two", "m", False)}


def test_globs():
    rx = records.glob_regex(["**/test*", "a/*.py", "b/**"])
    import re

    assert [bool(re.match(rx, p)) for p in ("test_x.py", "q/test", "a/x.py", "a/b/x.py", "b/c/d", "c/b")] == [True, True, True, False, True, False]


def test_ngrams_are_counted_in_their_rows(spark):
    """No n-gram is shuffled; rows that repeat a key are scored each; tokens may hold spaces, sides may be empty or null."""
    rows = [(1, ["a", "b", "c", "d", "a b"], ["a", "b", "c", "x", "a b"]), (1, ["a"], ["b"]), (2, ["a", "a"], ["a"] * 4), (3, None, ["a"]), (4, ["a"], None), (5, [], []), (6, ["a b"], ["a", "b"]), (None, ["a"], ["a"])]
    out = metrics.ngram_overlap(spark.createDataFrame(rows, "key int, r array<string>, h array<string>"), "key", "r", "h")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = [(1, (4 / 5 * 2 / 4 * 1 / 3) ** 0.25), (1, 0.0), (2, (2 / 4 * 1 / 3) ** 0.25), (3, 0.0), (4, 0.0), (5, 0.0), (6, 0.0), (None, 1.0)]
    assert [(r.key, r.score) for r in out.collect()] == [(k, pytest.approx(x, abs=1e-6)) for k, x in want]


def test_codebleu_groups_nothing(spark, sf):
    """Both overlaps and the matches come from one row of a pair: no n-gram is a row of its own."""
    from spindrift.plans import catalog

    plan = catalog.QUERIES["codebleu"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and plan.count("Join") == 1
