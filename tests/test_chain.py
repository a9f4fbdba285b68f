"""Configured chains, settings, sinks, listings, parsers of git and linters."""

import json

import pytest
from pyspark.sql import functions as F

from spindrift import chain
from spindrift.operators import explore
from spindrift.sources import records
from spindrift.tables import release


def test_chains(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as doc", "text as content", "'file_content' as context_type")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id as query", "text").limit(5)
    found = {name: chain.build(name).gather(docs, items) for name in chain.CHAINS}
    for name, rows in found.items():
        got = rows.collect()
        assert {r["query"] for r in got} <= {r["query"] for r in items.collect()} and got, name
        assert max(sum(r.tokens for r in got if r["query"] == q) for q in {r["query"] for r in got}) <= 8000
        release(rows)
    none = chain.build({"chain": "sparse", "steps": {"retriever": {"min_score": 1e9}}}).hits(docs, items)
    assert none.count() == 0
    preset = chain.build({"preset": "minimal", "chain": "reranked", "steps": {"reranker": {"top_k": 3}}})
    assert preset.settings["reranker"] == {"name": "overlap", "rerank_k": 50, "top_k": 3}
    for wrong in ("nothing", {"chain": "sparse", "steps": {"walk": {}}}, {"steps": {"context": {"tokens": 1}}}):
        with pytest.raises(KeyError):
            chain.build(wrong)
    with pytest.raises(KeyError):
        chain.build({"steps": {"reranker": {"name": "other"}}}).hits(docs, items)


def test_settings_are_read(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"model": "${NAME:-none}", "list": ["${KEY}", 3], "deep": {"x": "${NAME}!"}}))
    assert records.load_config(str(tmp_path / "a.json"), {"KEY": "k"}) == {"model": "none", "list": ["k", 3], "deep": {"x": "${NAME}!"}}
    (tmp_path / "e.json").write_text("null")
    assert records.load_config(str(tmp_path / "e.json"), {}) == {}


def test_predictions_are_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p\n+x", "m"), ("b", None, "m"), ("ü", '"q"', None)], "instance_id string, model_patch string, model_name_or_path string")
    records.write_records(rows, f"file://{tmp_path}/out.jsonl")
    back = records.read_predictions(spark, f"file://{tmp_path}/out.jsonl")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, map(tuple, rows.collect())))
    with pytest.raises(Exception, match="exist"):
        records.write_records(rows, f"file://{tmp_path}/out.jsonl")


def test_listing_has_sizes(spark):
    files = spark.createDataFrame([("a/b/c.py", "ab"), ("a/d.py", "ü"), ("e.py", None)], "path string, content string")
    got = {(r.kind, r.path): r.size for r in records.listing(files).collect()}
    assert got == {("file", "a/b/c.py"): 2, ("file", "a/d.py"): 2, ("file", "e.py"): None, ("folder", "a"): 4, ("folder", "a/b"): 2}


def test_binary_files_are_told_by_a_byte(spark, tmp_path):
    for name, data in {"a.py": b"p\n\0", "b.py": b"p\x10\x00", "c.py": b"p\n\x10\n", "d.py": b"", "e.py": b"x" * 2000 + b"\0"}.items():
        (tmp_path / name).write_bytes(data)
    assert {r.path for r in records.read_repository(spark, f"file://{tmp_path}").collect()} == {"c.py", "e.py"}


def test_parsers_of_listings(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert [tuple(r) for r in one("A\tx y.py\nR100\ta.py\tb.py\nnoise\nX\tq\nD\tz.py", explore.changed_files)] == [("added", "x y.py", None), ("renamed", "b.py", "a.py"), ("deleted", "z.py", None)]
    assert [tuple(r) for r in one("* main   1234abc Fix it\n  topic\n  remotes/origin/HEAD -> origin/main\n  remotes/up/a/b", explore.branches)] == [("main", None, True), ("topic", None, False), ("a/b", "up", False)]
    assert one("", explore.branches) == [] and one(None, explore.changed_files) is None
