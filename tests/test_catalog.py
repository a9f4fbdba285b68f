import ast
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import duck_rows, spark_rows

from spindrift.operators import report
from spindrift.plans import catalog, reporting

#: Queries that SQL can't express; each is tested against a plain computation below.
PLAIN = {"dense_ivf", "codebleu", "vector_index_probe", "token_counts", "vector_graph_search"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf, name):
    assert spark_rows(catalog.QUERIES[name](spark, sf)) == duck_rows(catalog.ORACLES[name], sf)


def test_every_query_is_checked():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) | PLAIN


def test_boundary_chunks(spark, sf):
    """The rule, walked through kind by kind with plain searches."""
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text, at = r.text, 0
        while at < len(text):
            stop = min(at + 1000, len(text))
            end = stop
            if stop < len(text):
                for kind in ("\n\n", "\n", ". ", " "):
                    places = [p for p in range(at + 801, stop + 1) if text[p : p + len(kind)] == kind and p + len(kind) <= stop + len(kind)]
                    if places and places[-1] < end:
                        end = places[-1] + len(kind)
            if len(text[at:end].strip()) >= 100:
                want[r.doc_id, at, text[at:end]] += 1
            if end >= len(text):
                break
            at = max(end - 200, at + 1)
    assert Counter(tuple(r) for r in catalog.QUERIES["char_chunks_boundary"](spark, sf).collect()) == want


def test_ivf_recall(spark):
    """A search of a quarter of the cells finds most of what a search of all rows does, with the same scores."""
    sf = "/root/testdata/sf0.1"
    exact = {(r.query, r.doc): r.score for r in catalog.QUERIES["dense_topk_ip"](spark, sf).collect()}
    found = {(r.query, r.doc): r.score for r in catalog.QUERIES["dense_ivf"](spark, sf).collect()}
    assert len(exact) == len(found) == 100 and all(found[k] == exact[k] for k in exact.keys() & found.keys())
    assert len(exact.keys() & found.keys()) >= 0.4 * len(exact)


def test_p_values(spark, sf):
    rows = reporting.results(spark, sf).select("method", "resolved").collect()
    n, k = Counter(r.method for r in rows), Counter(r.method for r in rows if r.resolved)
    got = {(r.method_a, r.method_b): r for r in catalog.QUERIES["pairwise_p_values"](spark, sf).collect()}
    assert set(got) == {(a, b) for a in n for b in n if a < b}
    for (a, b), r in got.items():
        table = [[k[a], n[a] - k[a]], [k[b], n[b] - k[b]]]
        total = n[a] + n[b]
        cols = [table[0][j] + table[1][j] for j in (0, 1)]
        expected = [[n[m] * cols[j] / total for j in (0, 1)] for m in (a, b)]
        gap = min(0.5, min(abs(table[i][j] - expected[i][j]) for i in (0, 1) for j in (0, 1)))
        chi = sum((abs(table[i][j] - expected[i][j]) - gap) ** 2 / expected[i][j] for i in (0, 1) for j in (0, 1))
        p = math.erfc(math.sqrt(chi / 2))
        assert r.chi2 == pytest.approx(chi, abs=1e-5) and r.p == pytest.approx(p, abs=1e-5)
        assert r.stars == ("***" if r.p < 0.001 else "**" if r.p < 0.01 else "*" if r.p < 0.05 else "")
    made = spark.createDataFrame([(m, i, i < c, True, 1.0, 1) for m, c in (("a", 90), ("b", 60), ("c", 85)) for i in range(100)], "method string, instance int, resolved boolean, applied boolean, seconds double, tokens int")
    assert {(r.method_a, r.method_b): r.stars for r in report.pairwise(made).collect()} == {("a", "b"): "***", ("a", "c"): "", ("b", "c"): "***"}


def _tokens(code):
    import re

    code = re.sub(r"#[^\n]*", "", code)
    for quote, inside in (('"""', "(?s:.*?)"), ("'''", "(?s:.*?)"), ('"', '[^"]*'), ("'", "[^']*")):  # strings are blank
        code = re.sub(quote + inside + quote, quote * 2, code)
    return re.findall(r"\w+|[^\w\s]", code)


def _overlap(ref, hyp):
    scores = []
    for n in range(1, 5):
        a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (ref, hyp))
        scores.append(sum((a & b).values()) / sum(b.values()) if b else 0.0)
    if not any(scores):
        return 0.0
    return math.exp(sum(math.log(s) for s in scores if s) / 4) * min(1.0, len(hyp) / len(ref))


def test_codebleu(spark, sf):
    from spindrift.operators.metrics import KEYWORDS
    from spindrift.plans import exploring

    text = {r.k: r.content for r in exploring.files(spark, sf).collect()}
    got = {r.key: r for r in catalog.QUERIES["codebleu"](spark, sf).collect()}
    assert set(got) == set(text) - {max(text)}
    heavy = lambda t: [x for w in t for x in ([w, w] if w in KEYWORDS else [w])]

    def parsed(code):
        try:
            return ast.parse(code)
        except SyntaxError:
            return None

    def flow(tree):
        uses = defaultdict(set)
        for x in ast.walk(tree):
            if isinstance(x, ast.Name):
                uses[x.id].add(type(x.ctx).__name__)
        return {(k, frozenset(v)) for k, v in uses.items()}

    for k, r in got.items():
        ref, hyp = _tokens(text[k]), _tokens(text[k + 1])
        parts = [_overlap(ref, hyp), _overlap(heavy(ref), heavy(hyp))]
        a, b = parsed(text[k]), parsed(text[k + 1])
        if a is None or b is None:
            parts += [parts[0], 0.0]
        else:
            x, y = ([type(n).__name__ for n in ast.walk(t)] for t in (a, b))
            parts += [sum(p == q for p, q in zip(x, y, strict=False)) / max(len(x), len(y)), len(flow(a) & flow(b)) / len(flow(a) | flow(b))]
        assert r.codebleu == pytest.approx(sum(parts) / 4, abs=2e-6), k


def test_generated_files_have_their_hash(spark, sf):
    """The files that code queries read are the same in each run."""
    from spindrift.plans import exploring

    text = "".join(r.path + r.content for r in exploring.files(spark, sf).orderBy("path").collect())
    again = "".join(r.path + r.content for r in exploring.files(spark, sf).orderBy("path").collect())
    assert hashlib.md5(text.encode()).hexdigest() == hashlib.md5(again.encode()).hexdigest() and np.char.count(text, "\nclass Base") == spark.read.parquet(f"{sf}/documents.parquet").count()
