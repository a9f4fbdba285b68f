"""Stored vector index, limiter, call graph, exploration loop, tokens: against plain versions, hard rows included."""

import base64
import re
from collections import deque

import numpy as np
import pandas as pd
import pytest
from compare import spark_rows
from pyspark.sql import functions as F

from spindrift import session, tables
from spindrift.operators import callgraph, dense, explore, explorer, tokens, vector_graph, vector_index
from spindrift.plans import catalog
from spindrift.streaming import limiter

# Stored vector index


def vectors(spark, n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim)], f"t{i}") for i in range(n)]
    rows += [(n, None, "null"), (n + 1, [], "empty"), (n + 2, [float("nan")] * dim, "nan"), (n + 3, [0.0] * dim, "zero"), (n + 4, rows[0][1], "copy"), (n + 4, rows[0][1], "copy")]
    return spark.createDataFrame(rows, "doc long, v array<double>, title string")


def test_index_is_loaded_and_exact(spark, tmp_path, monkeypatch):
    rows = vectors(spark)
    vector_index.build(rows, f"file://{tmp_path}/i", cells=12, model="m")
    from pyspark.ml.clustering import KMeans

    monkeypatch.setattr(KMeans, "fit", lambda *a: pytest.fail("fitted again"))
    index = vector_index.VectorIndex.load(spark, f"file://{tmp_path}/i")
    facts = index.facts.first()
    assert (facts["model"], facts["dim"], facts["n"]) == ("m", 8, 303) and index.lookup(3).first()["title"] == "t3"
    asked = rows.where("doc % 3 = 0 or doc = 301").selectExpr("doc as query", "v as qv")
    good = rows.where(vector_index.usable(F.col("v")))
    for metric in ("ip", "l2"):
        got = vector_index.search(index, asked, 7, probe=2, metric=metric, exact=True)
        want = dense.search(good.select("doc", "v"), asked.where(vector_index.usable(F.col("qv"))), 7, metric)
        assert spark_rows(got.select("query", "doc", "score", "rank")) == spark_rows(want.select("query", "doc", "score", "rank"))
    near = vector_index.search(index, asked.limit(1), 5, probe=1)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    assert 0 < vector_index.share_read(index, asked, 2) < 0.5
    kept = vector_index.search(index, asked, 3, probe=2, exact=True, keep=F.col("title") != "zero")
    assert kept.where("title = 'zero'").count() == 0
    tables.release(near, kept)


def test_index_recall_on_all_queries(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as doc", "embedding as v")
    path = tables.fresh(spark, "vectors")
    index = vector_index.build(rows, path, cells=32)
    asked = rows.selectExpr("doc as query", "v as qv")
    got = {(r.query, r.doc) for r in vector_index.search(index, asked, 10, probe=20).collect()}
    want = {(r.query, r.doc) for r in dense.search(rows, asked, 10).collect()}
    assert len(got & want) >= 0.9 * len(want) and vector_index.share_read(index, asked, 20) < 0.9


def test_empty_index(spark, tmp_path):
    index = vector_index.build(vectors(spark).where("doc < 0"), f"file://{tmp_path}/e")
    asked = spark.createDataFrame([(1, [1.0] * 8)], "query long, qv array<double>")
    assert vector_index.search(index, asked).count() == 0 and vector_index.search(index, asked, exact=True).count() == 0


def test_release_follows_what_is_made_of_a_result(spark, tmp_path):
    a, b = tables.cut(spark.range(5)), tables.cut(spark.range(5))
    for t in (a, b):
        assert tables.filesystem(spark, t._cuts[0])[0].exists(tables.filesystem(spark, t._cuts[0])[1])
    out = tables.reading(a.join(b, "id"), a, b).select("id").where("id > 1")
    assert out.count() == 3
    other = tables.cut(out)
    tables.release(out)
    for t in (a, b):
        assert not tables.filesystem(spark, t._cuts[0])[0].exists(tables.filesystem(spark, t._cuts[0])[1])
    assert other.count() == 3
    tables.release(other)


def test_package_as_zip(tmp_path):
    import subprocess
    import sys

    path = session.packed(str(tmp_path))
    said = subprocess.run([sys.executable, "-c", "import spindrift.operators.tokens as t; print(t.__file__)"], cwd=tmp_path, env={"PYTHONPATH": path, "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert path in said.stdout, said.stderr


def test_graph_sends_vectors_by_links(spark):
    """A round joins no vectors to pairs, its graph is near to the exact one, and a row that all are near to has no larger meeting."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 8))
    v[0] = 0.01
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [float("nan")] * 8)], "doc long, v array<float>")
    for metric, score in (("ip", v @ v.T), ("l2", -((v[:, None] - v[None]) ** 2).sum(2))):
        graph = vector_graph.build(rows, degree=8, rounds=3, metric=metric)
        score = score - np.diag(np.full(400, np.inf))
        want = {(a, int(b)) for a in range(400) for b in np.argsort(-score[a])[:8]}
        got = {(r.a, r.b): r.score for r in graph.collect()}
        assert len(got.keys() & want) >= 0.9 * len(want) and len(got) == 3200
        assert all(abs(s - score[a, b]) < 1e-5 for (a, b), s in got.items())
        links = graph.select("a", "b")
        met = vector_graph._met(links, rows.where("doc < 400"), graph, 8, metric)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in met and met.count("Join") == 4
        tables.release(graph)


# Limiter


def plain_admissions(asked, requests, limit, span):
    """Each request goes at the first moment at which the rules hold, found by trying every candidate."""
    went, out = [], []
    for arrival, n in asked:
        least = max([arrival] + [t for t, _ in went[-1:]])
        for at in sorted({least, *(t + span for t, _ in went if t + span > least)}):
            inside = [m for t, m in went if at - span < t]
            if len(inside) < requests and (sum(inside) + n <= limit or not inside):
                break
        went.append((at, n))
        out.append(at)
    return out


def test_admissions():
    rng = np.random.default_rng(2)
    for _ in range(200):
        asked = sorted((int(a), int(n)) for a, n in zip(rng.integers(0, 400, 60), rng.integers(0, 50, 60), strict=True))
        asked[10] = (asked[10][0], 500)
        went, last, got = deque(), 0, []
        for a, n in asked:
            last = limiter.admit(went, last, a, n, 5, 120, 60)
            got.append(last)
        assert got == plain_admissions(asked, 5, 120, 60)


def test_limiter_stream(spark, tmp_path):
    """Two starts of one stream: what came late waits behind what went, nulls and empty parts do no harm."""
    schema = "client string, id long, arrival long, tokens long"
    first = [("a", i, 1000 * i, 10) for i in range(5)] + [(None, 50, 100, None), ("a", 60, None, 1), ("a", None, 5, 1)]
    second = [("a", 7, 500, 10), ("a", 8, 300_000, 10), (None, 51, 300_000, 1), ("b", 9, 200_000, 10**9)]
    out = None
    for n, part in enumerate((first, second, [])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"file://{tmp_path}/in/*")
        limiter.run_limited(limiter.limit(stream, "1 second", requests=2, tokens=100, span=60_000), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
        out = {(r.client, r.id): r.admitted for r in spark.read.schema(limiter.OUT).parquet(f"file://{tmp_path}/out").collect()}
    # The watermark is at 3000 after the first part and at 299000 after the second.
    assert out == {("a", 0): 0, ("a", 1): 1000, ("a", 2): 60_000, (None, 50): 100, ("a", 3): 61_000, ("a", 7): 120_000, ("a", 4): 121_000, ("b", 9): 200_000}


def test_limiter_has_one_timer(spark, tmp_path):
    """However many requests wait a client has one timer, and one that is due is followed by the next, also without new requests."""

    class State(list):
        reads, get, exists = 0, lambda self: setattr(self, "reads", self.reads + 1) or iter(list(self)), lambda self: bool(self)
        appendList, appendValue, put = list.extend, list.append, lambda self, rows: self.__setitem__(slice(None), rows)

    class Handle:
        def __init__(self):
            self.lists, self.timers, self.made = {}, set(), 0
            self.listTimers, self.deleteTimer = lambda: iter(sorted(self.timers)), self.timers.discard

        def getListState(self, name, schema):
            return self.lists.setdefault(name, State())

        def registerTimer(self, t):
            self.made += 1
            self.timers.add(t)

    class Times:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = lambda: now

    one, handle = limiter.Limiter(3, 100, 50), Handle()
    one.init(handle)
    asked = [(i, 7 * i % 1000, 1 + i % 60) for i in range(1000)]
    frame = pd.DataFrame(asked, columns=["id", "arrival", "tokens"])
    list(one.handleInputRows(("a",), iter([frame[:600], frame[600:]]), Times(0)))
    assert handle.timers == {1} and handle.made == 1
    out = []
    for now in (400, 2000):
        due = [t for t in handle.timers if t <= now]
        assert len(due) == 1
        for t in due:
            out += [r for part in one.handleExpiredTimer(("a",), Times(now), t) for r in part.itertuples(index=False)]
            handle.timers.discard(t)
    assert handle.made == 2 and handle.lists["waiting"].reads == 2 and not handle.timers
    order = sorted((a, i, n) for i, a, n in asked)
    assert [(r.arrival, r.id, r.tokens) for r in out] == order
    assert [r.admitted for r in out] == plain_admissions([(a, n) for a, _, n in order], 3, 100, 50)
    # In a stream: the second part has other clients only, yet what client a left waiting goes.
    schema = "client string, id long, arrival long, tokens long"
    for n, part in enumerate(([("a", i, 1000 * i, 1) for i in range(5)], [("b", 9, 100_000, 1)])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in/*")
        limiter.run_limited(limiter.limit(stream, "2 seconds"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert {(r.client, r.id): r.admitted for r in spark.read.schema(limiter.OUT).parquet(f"file://{tmp_path}/out").collect()} == {("a", i): 1000 * i for i in range(5)}


# Call graph

FILES = {
    "pkg/__init__.py": "from .core import Base as Root\n",
    "pkg/core.py": "import os\n\ndef run():\n    return os.getcwd()\n\nclass Base:\n    def go(self):\n        return self.step()\n    def step(self):\n        return run()\n    @classmethod\n    def make(cls):\n        return cls.step(cls)\n",
    "pkg/sub/leaf.py": "from ..core import Base, run as start\nimport pkg.core as core\nimport pkg.core\n\nclass Mid(Base):\n    def step(self):\n        return super().step()\n\nclass Leaf(Mid):\n    def go(self):\n        start()\n        core.run()\n        pkg.core.run()\n        Base.make()\n        Mid().go()\n        def run():\n            return self.step()\n        return run()\n    class Inner:\n        def go(self):\n            return self.missing()\n\nasync def run(x=start()):\n    [y.close() for y in x]\n    return unknown(len(x))\n\nLeaf().go()\n",
    "other.py": "from pkg import Root\nclass Far(Root):\n    pass\nclass A(B):\n    def f(self):\n        return self.f()\nclass B(A):\n    pass\ndef run():\n    return run()\n",
    "bad.py": "def (:\n",
}


def test_calls_resolved(spark):
    table = callgraph.facts(spark.createDataFrame([*FILES.items(), ("null.py", None)], "path string, content string"))
    got = {(r.caller, r.receiver, r.name, r.callee, r.how) for r in callgraph.resolve(table).collect()}
    core, leaf = "pkg/core.py:", "pkg/sub/leaf.py:"
    assert got == {
        (core + "run", "os", "getcwd", None, "unknown"),
        (core + "Base.go", "self", "step", core + "Base.step", "self"),
        (core + "Base.step", None, "run", core + "run", "local"),
        (core + "Base.make", "cls", "step", core + "Base.step", "self"),
        (leaf + "Mid.step", "super()", "step", core + "Base.step", "super"),
        (leaf + "Leaf.go", None, "start", core + "run", "imported"),
        (leaf + "Leaf.go", "core", "run", core + "run", "module"),
        (leaf + "Leaf.go", "pkg.core", "run", core + "run", "module"),
        (leaf + "Leaf.go", "Base", "make", core + "Base.make", "class"),
        (leaf + "Leaf.go", None, "Mid", leaf + "Mid", "local"),
        (leaf + "Leaf.go", "Mid()", "go", core + "Base.go", "class"),
        (leaf + "Leaf.go", None, "run", leaf + "Leaf.go.run", "local"),
        (leaf + "Leaf.go.run", "self", "step", leaf + "Mid.step", "self"),
        (leaf + "Leaf.Inner.go", "self", "missing", None, "unknown"),
        (leaf + "run", None, "start", core + "run", "imported"),
        (leaf + "run", "y", "close", None, "unknown"),
        (leaf + "run", None, "unknown", None, "unknown"),
        (leaf + "run", None, "len", None, "unknown"),
        (leaf, None, "Leaf", leaf + "Leaf", "local"),
        (leaf, "Leaf()", "go", leaf + "Leaf.go", "class"),
        ("other.py:A.f", "self", "f", "other.py:A.f", "self"),
        ("other.py:run", None, "run", "other.py:run", "local"),
    }
    reach = {r.function: tuple(r)[1:] for r in callgraph.reach(callgraph.resolve(table)).collect()}
    assert reach["other.py:run"] == (1, 1, 1, 1)
    callers = {(c, t) for c, _, _, t, _ in got if t}
    closed = set(callers)
    while more := {(a, d) for a, b in closed for c, d in callers if b == c} - closed:
        closed |= more
    for f, (direct_in, direct_out, all_in, all_out) in reach.items():
        assert (direct_in, direct_out) == (sum(t == f for _, t in callers), sum(c == f for c, _ in callers))
        assert (all_in, all_out) == (sum(t == f for _, t in closed), sum(c == f for c, _ in closed))
    assert callgraph.resolve(callgraph.facts(spark.createDataFrame([], "path string, content string"))).count() == 0


# Exploration loop


def test_loop_ends_each_instance(spark):
    files = spark.createDataFrame([("a.py", "class FooBar:\n    def load_it(self):\n        pass\n    def load_more(self):\n        pass\n"), ("b.py", "x = load_it\n"), ("c.py", "y = FooBar\n"), ("n.py", None)], "path string, content string")
    asked = spark.createDataFrame([(1, ["FooBar", "load_it", "load_"]), (2, ["nothing_here"]), (3, []), (None, None)], "instance long, keywords array<string>")
    found = explorer.answers(asked, files, explore.symbols(files))
    log = explorer.explore_all(asked, found, least=3, most=14)
    rows = {}
    for r in log.collect():
        rows.setdefault(r.instance, []).append((r.iteration, r.tool, r.parameter, r.results))
    steps = {k: sorted(v) for k, v in rows.items()}
    assert steps[1] == [(1, "grep", "FooBar", "a.py,c.py"), (2, "grep", "load_it", "a.py,b.py"), (3, "grep", "load_", "a.py,b.py"), (4, "view_file", "a.py", ""), (5, "view_file", "c.py", ""), (6, "view_file", "b.py", ""), (7, "search_class", "FooBar", "FooBar"), (8, "search_class", "FooBar", "FooBar"), (9, "search_class", "FooBar", "FooBar"), (10, "search_method", "load_", "load_it,load_more")]
    assert [s[1] for s in steps[2]] == ["grep"] * 3 + ["search_method"] * 9 + ["find_file"] * 2
    assert [s[1] for s in steps[3]] == ["find_file"] * 14 == [s[1] for s in steps[None]]
    tables.release(log)


# Tokens


def library():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), tokens.Vocabulary(tuple(ranks.items()), P.PATTERN)


def test_tokens_are_the_library_s(spark, sf):
    encoding, vocabulary = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in catalog.QUERIES["token_counts"](spark, sf).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        ids = encoding.encode_ordinary(t)
        assert got[k].tokens == len(ids)
        whole = [m for m in range(min(100, len(ids)), -1, -1) if t.encode().startswith(b := encoding.decode_bytes(ids[:m])) and b.decode("utf-8", "ignore").encode() == b]
        assert got[k].first_chars == len(encoding.decode(ids[: whole[0]]))
    encoder = tokens.Encoder(vocabulary)
    for t in ["日本語 👍🏽 x", "  \n\n  a  ", "", " ", "ééé", "a" * 5000, "\u0000"]:
        assert encoder.lengths(t) == [len(b) for b in encoding.decode_tokens_bytes(encoding.encode_ordinary(t))]
        for width, lap in ((1, 0), (5, 0), (7, 3), (64, 63)):
            spans = tokens.spans(encoder.edges(t), width, lap)
            assert lap or "".join(t[a:b] for a, b, _ in spans) == t
            assert not t or (spans[0][0] == 0 and spans[-1][1] == len(t) and all(b >= c > a for (a, b, _), (c, _, _) in zip(spans, spans[1:], strict=False)))


def test_token_columns(spark):
    _, vocabulary = library()
    d = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four"), (3, "one two three four")], "id long, text string")
    c = F.col("text")
    got = d.select("id", tokens.count(c, vocabulary).alias("n"), tokens.truncate(c, 2, vocabulary).alias("a"), tokens.truncate(c, 2, vocabulary, "left").alias("b"), tokens.windows(c, 3, 1, vocabulary).alias("w")).collect()
    rows = sorted((r.id, r.n, r.a, r.b, [tuple(w) for w in r.w]) for r in got)
    assert rows == [(1, 0, None, None, []), (2, 0, "", "", [])] + [(3, 4, "one two", " three four", [(0, 13, 3), (7, 18, 2)])] * 2
    with pytest.raises(ValueError):
        tokens.windows(c, 2, 2, vocabulary)
    with pytest.raises(ValueError):
        tokens.truncate(c, 2, vocabulary, "middle")


def test_texts_are_encoded_once(spark, sf):
    """One Python worker makes all three columns, which are those of the separate functions."""
    plan = catalog.QUERIES["token_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
    _, vocabulary = library()
    d = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four"), (3, "one two three four"), (4, "日本語 👍🏽 x" * 3)], "id long, text string")
    c = F.col("text")
    for n in (0, 2, 100):
        both = d.select(tokens.count_and_cut(c, n, vocabulary).alias("t"), tokens.count(c, vocabulary).alias("n"), tokens.truncate(c, n, vocabulary).alias("a"), tokens.truncate(c, n, vocabulary, "left").alias("b")).collect()
        assert [tuple(r.t) for r in both] == [(r.n, r.a, r.b) for r in both]


def test_new_pieces_are_merged_together(monkeypatch):
    """Pieces of several lengths, long ones and ones forgotten in between have the library's tokens; texts keep their order."""
    encoding, vocabulary = library()
    want = lambda t: [len(b) for b in encoding.decode_tokens_bytes(encoding.encode_ordinary(t))]
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    monkeypatch.setattr(tokens, "TOGETHER", 3)
    monkeypatch.setattr(tokens, "AT_HAND", 40)
    texts = [f"qx{i}zzv wq{'vk' * (i % 40)}j éß{'ñ' * i} {'ab' * i}" for i in range(60)] + [None, "", "x" * 48 + " " + "y" * 49]
    encoder = tokens.Encoder(vocabulary)
    for t, pieces in encoder.cut(texts):
        assert encoder.count(pieces) == len(want(t or ""))
        assert [n for p in pieces for n in encoder.known[p]] == want(t or "")
    assert [t for t, _ in encoder.cut(texts)] == texts
