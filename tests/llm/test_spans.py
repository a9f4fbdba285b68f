"""Fill-in-middle, benchmark phrases and periodic runs: against plain versions of their contracts, hard rows included."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, fim, fm_index, periodic_runs, queries

SCHEMA = "doc_id long, text string, n long, form string, spans string, id string, runs int, n_words int, output string"
LONG = " ".join(f"word{i % 97} x{i % 13}" for i in range(30_000))
HARD = [None, "", "one", "one", "\n", "\n\na", "a\nb\nc", "a\nb\nc\n", "ä\nöß\n\n\nü", "has <M> inside\nb\nc", "no mark <P\n>b\n<S", LONG, "a a a a a a a", "x y x y x y x y x", "A b. C d; 3 e\tf g h i j k", "\x0b \x1c y\x1cz \x85 \xa0"]


def docs(spark, texts, ids=None):
    ids = ids or [None if i == 5 else i // 2 * 2 for i in range(len(texts))]
    return spark.createDataFrame([(i, t, 1, "plain", "s", "x", 2, 3, "o") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fim_row(i, t):
    t = t or ""
    d = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
        return i, len(u), "plain", None, None, t
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return i, len(u), "spm" if h[3] % 100 < 50 else "psm", len(p), len(m), out


def test_fim(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = HARD + ["".join(rng.choice(["a", "\n", "<", "S", ">", "ß", " "], 40)) for _ in range(60)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_fim_runs(spark, str(tmp_path)).collect()
    ids = [None if i == 5 else i // 2 * 2 for i in range(len(texts))]
    want = [(*(r := fim_row(i, t))[:5], sha(r[5]), sha(t or "")) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert fim.transform(docs(spark, []), F.lit(1), F.lit(2), F.lit("psm")).count() == 0
    nulls = fim.transform(docs(spark, ["a\nb"]), F.lit(None), F.lit(None).cast("long"), F.lit(None).cast("string")).first()
    assert nulls.form == "plain" and nulls.output == "a\nb" and nulls.n == 2


def plain_phrases(texts, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in items:
        w = split(t)
        for k in range(len(w) - window + 1) if len(w) >= window else range(bool(w)):
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for t in texts:
        w, hit, names = split(t), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                found = grams.get(tuple(w[k : k + size]))
                if found is not None:
                    hit.update(range(k, k + size))
                    names |= found - {None}
        out.append((len(w), sorted(hit), sorted(map(str, names))))
    return out


@pytest.mark.parametrize("shard_words,phrase_bytes", [(900_000, 1 << 20), (40, 1 << 20), (900_000, 300)])
def test_phrases(spark, shard_words, phrase_bytes):
    rng = np.random.default_rng(4)
    vocabulary = ["a", "b", "Ab", "öl", "longerwordthaneight", "longerwordthaneighu", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(n)) for k, n in enumerate([3, 4, 5, 6, 9, 15, 30])] + [(3, text(5)), (None, text(4)), (20, None), (21, "..."), (22, "x1 x1 never"), (0, "a b")]
    texts = HARD + [text(n) for n in rng.integers(0, 300, 40)] + ["pre " + items[5][1] + ". " + items[6][1]] * 3
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_phrases(docs(spark, texts), table, window=4, shard_words=shard_words, phrase_bytes=phrase_bytes).collect()
    flat = lambda spans: [i for a, b in spans for i in range(a, b)]
    got = sorted((str(r.doc_id), r.n_words, flat(r.spans), list(r["items"])) for r in found)
    ids = [None if i == 5 else i // 2 * 2 for i in range(len(texts))]
    assert got == sorted((str(i), *w) for i, w in zip(ids, plain_phrases(texts, items, 4), strict=True))
    assert all(b < c for r in found for (_, b), (c, _) in zip(r.spans, r.spans[1:], strict=False))
    assert decontaminate.find_phrases(docs(spark, []), table, window=4).count() == 0
    none = decontaminate.find_phrases(docs(spark, texts), table.where("item_id = 20"), window=4).collect()
    assert len(none) == len(texts) and not any(r.spans for r in none)


def test_phrases_clean(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "four")], "item_id long, text string")
    texts = ["Zero ONE, two; three! five four. six", "nothing", None, "four", "one two\nthree four"]
    got = decontaminate.find_phrases(docs(spark, texts), items, clean=True).collect()
    assert sorted((r.clean, len(r.spans)) for r in got) == sorted([("Zero ! five . six", 2), ("nothing", 0), ("", 0), ("", 1), ("", 1)])


def test_long_documents_in_pieces(spark, monkeypatch):
    """Documents longer than an index are cut into pieces that overlap: no occurrence over a cut is lost or counted twice."""
    monkeypatch.setattr(decontaminate, "MOST", 60)
    rng = np.random.default_rng(5)
    codes = rng.integers(1, 4, 500).astype(np.uint64)
    bounds = np.array([0, 250, 255, 255, 500])
    p = decontaminate.Phrases.of([str(i) for i in range(9)], [b"a b c", b"", *[b"b b"] * 7], 3)
    p.words = np.array([1, 2, 3], dtype=np.uint64)[: len(p.words)]
    d, s, e, w = decontaminate._find(codes, bounds, p, 30)
    want = set()
    for k, row in enumerate(p.windows):
        sym = [int(p.words[c]) for c in row if c >= 0]
        for doc in range(4):
            part = codes[bounds[doc] : bounds[doc + 1]].tolist()
            want |= {(doc, i, i + len(sym), k) for i in range(len(part) - len(sym) + 1) if part[i : i + len(sym)] == sym}
    assert set(zip(d.tolist(), s.tolist(), e.tolist(), w.tolist(), strict=True)) == want and want


def test_fm_index():
    rng = np.random.default_rng(6)
    for n, sigma in [(1, 2), (2, 2), (70, 2), (300, 3), (4000, 5), (4000, 300)]:
        t = rng.integers(0, sigma, n)
        t[n // 2 : n // 2 + n // 4] = t[: n // 4]
        t[-1] = 0
        index = fm_index.FmIndex.build(t, sigma)
        asked = [t[i : i + k] for i in rng.integers(0, n, 20) for k in (1, 2, 5) if i + k <= n] + [rng.integers(1, sigma, 3) for _ in range(20)]
        asked = [a for a in asked if (a > 0).all()]
        rows = np.array([np.concatenate([np.full(5 - len(a), -1), a]) for a in asked]).reshape(-1, 5)
        for a, lo, hi in zip(asked, *index.search(rows), strict=True):
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == [i for i in range(n - len(a) + 1) if (t[i : i + len(a)] == a).all()]
    with pytest.raises(ValueError):
        fm_index.FmIndex.build(np.array([0, 1]), 2)


def plain_runs(c):
    out = {}
    for q in range(len(c) // 4, 0, -1):
        i = 0
        while i + q < len(c):
            a = i
            while i + q < len(c) and c[i] == c[i + q]:
                i += 1
            if i > a and i + q - a >= max(6, 4 * q):
                out[a, i + q] = q
            i += i == a
    return sorted((a, b - a, q) for (a, b), q in out.items())


def runs_row(i, t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    h = zlib.crc32(("" if i is None else str(i)).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(said), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def test_runs(spark, tmp_path):
    rng = np.random.default_rng(7)
    texts = [t for t in HARD if t is not LONG]
    for _ in range(300):
        n, few = int(rng.integers(0, 120)), int(rng.integers(1, 30))
        w = [f"{'averylongword' if x % 3 else ''}{x}" for x in rng.integers(0, few, n)]
        a, p = int(rng.integers(0, n + 1)), int(rng.integers(1, 12))
        texts.append(" ".join(w[:a] + [w[a + (k - a) % p] if a + p <= n else w[k] for k in range(a, n)]))
    texts += ["\n".join(["the same line again"] * 30) + " end", " ".join(bin(k).count("1") % 2 * "b" or "a" for k in range(2100))]
    docs(spark, texts, list(range(len(texts) - 1)) + [None]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    want = [runs_row(i, t) for i, t in zip([*range(len(texts) - 1), None], texts, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r.n_runs > 0 for r in got) > 100
    repeated = periodic_runs.find_runs(docs(spark, HARD))
    assert repeated.count() == len(HARD) and repeated.where("n_words = 60000").first().runs[0].period == 97 * 2 * 13
    assert periodic_runs.find_runs(docs(spark, [])).count() == 0


def test_runs_without_trust_in_hashes(monkeypatch):
    """A hash that is always equal leads to the exact way."""
    codes = np.array([1, 2, 1, 2, 1, 2, 1, 2, 1, 3, 3, 3, 3, 3, 3, 4])
    bounds = np.array([0, len(codes)])
    right = periodic_runs.document_runs(codes, bounds)
    assert right == [[(0, 9, 2), (9, 6, 1)]]
    monkeypatch.setattr(periodic_runs._Same, "equal", lambda self, i, p, n: np.ones(len(i), dtype=bool))
    assert periodic_runs.document_runs(codes, bounds) == right
