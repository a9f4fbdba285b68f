"""Hard rows of the operators: null, large, repeated ids, empty and long texts, clashing columns, hot keys, against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import HARD, LONG, by_id, docs, exact_components

import corpus_pipeline
from spindrift.llm import ann, chat_format, common, fingerprints, license_scan, minhash_dedup, mixing, packing, quality, url_filters
from spindrift.llm.license_texts import KNOWN
from spindrift.llm.shingles import Words, shingle_sets

BIG = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63)]
IDS = "doc_id long, text string"


def test_large_ids_beside_a_null(spark):
    rows = [(i, f"text number {i} with some words of its own") for i in BIG] + [(None, "no id at all, but words"), (None, None)]
    d = spark.createDataFrame(rows, IDS).coalesce(1)
    want = Counter(i for i, _ in rows)
    assert Counter(r.doc_id for r in minhash_dedup.near_duplicates(d).collect()) == want
    assert Counter(r.doc_id for r in packing.pack(d).where("start = 0").collect()) == want
    assert Counter(r.doc_id for r in fingerprints.fingerprint_edits(d).collect()) == want
    c = spark.createDataFrame([(i, 0, "assistant", "x") for i in [*BIG, None]], "conv_id long, turn long, role string, text string").coalesce(1)
    ex = chat_format.format_conversations(c)
    assert {r.conv_id for r in chat_format.read_back(ex).collect()} == {*BIG, None} == {r.conv_id for r in chat_format.expand_examples(ex).collect()}


def test_near_duplicates_hard_rows(spark):
    got = Counter(tuple(r) for r in minhash_dedup.near_duplicates(docs(spark, HARD)).collect())
    long = len({tuple(LONG.split()[k : k + 5]) for k in range(len(LONG.split()) - 4)})
    assert got == Counter([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (None, 1, None, False), (5, long, 5, True), (6, 8, 6, True), (7, 8, 6, False), (8, 0, 8, True)])
    # An id with two texts, one a copy of an earlier document's; copies without an id.
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text of its own"), (None, "a b c d e f"), (None, "p q r s t"), (None, "p q r s t")]
    d = spark.createDataFrame(rows, IDS)
    assert Counter((r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(d).collect()) == Counter([(1, 1), (2, 1), (2, 2), (None, 1), (None, None), (None, None)])
    kept = Counter(tuple(r) for r in minhash_dedup.keep_one(d).collect())
    assert kept == Counter([(1, "a b c d e f"), (2, "quite another text of its own"), (None, "p q r s t")])


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_a_polynomial_hash_confuses(spark):
    a = _thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    assert shingle_sets([a])[0].tolist() != shingle_sets([b])[0].tolist() and Words("A b\tC").common(Words("a B c")) == 1 and Words("x").common(Words("")) == 0
    got = by_id(minhash_dedup.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a.upper())], IDS)))
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 2, 1]


@pytest.mark.parametrize("exact", [False, True])
def test_family_under_the_threshold(spark, exact):
    """Many texts that are nearly near: edits from a small pool, so that no shingle is a text's own."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(250):
        w = list(base)
        for p in rng.choice(200, 4 + k % 3, replace=False):
            w[p] = f"v{rng.integers(0, 3)}"
        rows.append((k, " ".join(w)))
    got = by_id(minhash_dedup.near_duplicates(spark.createDataFrame(rows, IDS), percent=85, exact=exact))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == exact_components(rows, 85)


def test_prefix_pairs_lose_none(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(120):
        w = [f"b{k % 6}_{i}" for i in range(rng.integers(5, 90))]
        for p in rng.integers(0, len(w), rng.integers(0, 4)):
            w[p] = f"e{rng.integers(0, 9)}"
        rows.append((f"{k:04d}".encode(), " ".join(w)))
    t = spark.createDataFrame(rows, "id binary, text string").withColumn("c", F.col("id"))
    found = {frozenset((bytes(r.a), bytes(r.b))) for r in minhash_dedup.prefix_pairs(t, 80, 5).collect()}
    sets = {i: set(shingle_sets([x])[0].tolist()) for i, x in rows}
    near = {frozenset((a, b)) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert near and near <= found


def test_examples_as_a_naive_expansion(spark):
    rng = np.random.default_rng(2)
    rows = [(int(c), int(t), ["system", "user", "assistant", None][rng.integers(0, 4)], ["x", "", None, "</turn> ### user: y\\"][rng.integers(0, 4)]) for c in range(30) for t in range(rng.integers(1, 8))]
    rows += [(5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (7, None, "assistant", "first"), (None, 1, "assistant", "b"), (None, 0, "user", "a")]
    d = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], "conv_id long, turn long, role string, text string, example_no long, addition string, target string")
    by = defaultdict(list)
    none_first = lambda x: (x is not None, x if x is not None else 0)
    for r in sorted(rows, key=lambda r: (none_first(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        by[r[0]].append(r)
    want = set()
    for c, turns in by.items():
        text = ""
        for _, _, role, said in turns:
            one, lo, hi = chat_format.turn_text(role, said)
            if role == "assistant":
                want.add((c, text + one, len(text) + lo, len(text) + hi))
            text += one
    ex = chat_format.format_conversations(d)
    got = [(r.conv_id, r.text, r.loss_start, r.loss_end) for r in chat_format.expand_examples(ex).collect()]
    assert set(got) == want and len(got) == sum(r[2] == "assistant" for r in rows)
    back = by_id(chat_format.read_back(ex), "conv_id")
    assert by_id(chat_format.read_examples(chat_format.expand_examples(ex, rest=True)), "conv_id") == back
    named = chat_format.format_conversations(d.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string"))))
    texts = by_id(chat_format.read_examples(chat_format.expand_examples(named, rest=True)), "conv_id")
    assert {k and int(k[1:]): tuple(r)[1:] for k, r in texts.items()} == {k: tuple(r)[1:] for k, r in back.items()}
    assert {c: (r.n_turns, r.turns_sha256) for c, r in back.items()} == {c: (len(t), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in t).encode()).hexdigest()) for c, t in by.items()}
    with pytest.raises(Exception, match="begins at"):
        chat_format.read_back(ex.withColumn("prefix_chars", F.col("prefix_chars") + 1)).collect()


def test_long_context_in_rows(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "MAX_ROW", 50)
    rows = [(1, t, "user" if t % 5 else "assistant", f"turn {t} " * 4) for t in range(1, 21)]
    ex = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = "".join(chat_format.turn_text(r[2], r[3])[0] for r in rows)
    got = chat_format.expand_examples(ex).collect()
    assert len(got) == 4 and all(whole.startswith(r.text) for r in got) and ex.where("not target").count() > 4


def test_packing_hard_rows(spark):
    d = docs(spark, HARD).withColumn("start", F.lit("s")).withColumn("ids", F.lit(0))
    got = packing.pack(d).collect()
    each = Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    sizes = [len(b) // 4 for b in packing.Encoder()([t for _, t, _, _ in HARD])]
    assert each == Counter((i, n) for (i, _, _, _), n in zip(HARD, sizes, strict=True))
    assert sum(r.length for r in got) == sum(sizes)


def _family(n, places=20, words=200, seed=11):
    """Texts of one family without rare shingles: each of the places has one of two words."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    at = sorted(rng.choice(words, places, replace=False).tolist())
    out = []
    for bits in rng.integers(0, 2, (n, places)).tolist():
        t = base.copy()
        for p, b in zip(at, bits, strict=True):
            t[p] = f"{'xy'[b]}{p}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("exact", [False, True])
def test_pairs_of_a_family_without_rare_shingles(spark, monkeypatch, exact):
    """The links are those of brute force, and few more pairs than these and a centre for each text are compared on their texts."""
    compared = []
    plain = minhash_dedup.verify

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(minhash_dedup, "verify", counting)
    for n in (150, 500):
        texts = _family(n)
        sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
        parent = list(range(n))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        links = 0
        for a in range(n):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    links += 1
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
        compared.clear()
        got = by_id(minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent=85, exact=exact))
        assert [got[i].component_id for i in range(n)] == [root(i) for i in range(n)]
        if exact:
            assert sum(compared) <= 2 * links + n
        else:
            assert compared[0] <= n and compared[1] <= 24 * n and compared[2] <= 2 * links + n


def _brute_nearest(rows, k=5, every=50):
    ids = np.array([i for i, _ in rows])
    x = ann.unit(np.array([v for _, v in rows], dtype=float))
    out = {}
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        best = {}
        for v, s in zip(ids.tolist(), (x[ids == q] @ x.T).max(axis=0).tolist(), strict=True):
            if v != q:
                best[v] = max(s, best.get(v, -2))
        out[q] = sorted(best, key=lambda v: (-round(best[v], 12), v))[:k]
    return out


@pytest.mark.parametrize("heads,parts,share", [(1, None, 0.5), (2, 32, 0.65), (2, 128, 0.5)])
def test_ann_routes(spark, heads, parts, share):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumn("part", F.lit(1)).withColumn("id", F.lit("x"))
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    found = ann.nearest(e, heads=heads, parts=parts).collect()
    want, got = _brute_nearest(rows), defaultdict(set)
    for r in found:
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & set(v)) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))
    # Far fewer rows are scored than there are.
    assert sum(r.scored for r in found) < share * len(want) * len(rows)


def test_ann_routes_with_few_different_vectors(spark):
    """Four of five rows have one vector: the others are still searched part by part, and nothing is lost."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=16)] if i % 5 == 0 else [1.0] * 16) for i in range(6000)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want, got = _brute_nearest(rows), defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert sum(len(set(got[q]) & set(v)) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))
    assert 0 < sum(r.scored for r in found) < 0.5 * len(want) * len(rows)
    odd = [(i + 1 if i % 50 == 0 else i, v) for i, v in rows if i % 5 or i % 50 == 0] + [(50 * j, [1.0] * 16) for j in range(200)]
    hot = ann.nearest(spark.createDataFrame(odd, "vec_id long, embedding array<double>")).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in hot] == _brute_nearest([r for r in odd])[100]


def test_ann_blocks_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 64)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 500)] + [(i, [1.0, float(i)]) for i in range(1000, 1060)] + [(50, [1e300, -1e300]), (51, [1e-300, 1e-300, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(d, parts=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[100] == [0, 1, 2, 3, 4] and got[1000] == [1001, 1002, 1003, 1004, 1005]
    assert set(got) == {i for i, _ in rows if i % 50 == 0} and all(len(v) == 5 for v in got.values())


def test_mixing_keeps_the_tree(spark):
    d = spark.createDataFrame([(i if i % 3 else None, f"w{i} " * (1 + i % 40), f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    shards, block = 8, 300
    mixed = mixing.mix(d, shards=shards, block_words=block).collect()
    sizes = Counter()
    for r in mixed:
        sizes[r.source] += r.size
    names = sorted(sizes)
    planned = mixing.plan([(n, sizes[n], 300) for n in names], [3.0, 1.0, 2.0], 1.5, shards, block, 11)
    owned = defaultdict(set)
    for r in mixed:
        for c in r.copies:
            owned[r.source, c.shard].add(c.block)
    for name, _, _, target, words, blocks, _, _, bounds in planned:
        quotas = np.diff([0, *bounds])
        held = [owned[name, s] for s in range(shards)]
        assert sum(len(h) for h in held) == len(set().union(*held)) <= blocks  # no block in two shards
        assert all(len(h) <= q for h, q in zip(held, quotas, strict=True)) and bounds[-1] == blocks
        assert sum(c["words"] for r in mixed if r.source == name for c in r.copies) == words == math.floor(target + 0.5)
    total = [sum(p[8][s] - (p[8][s - 1] if s else 0) for p in planned) for s in range(shards)]
    assert max(total) - min(total) <= 3
    again = mixing.mix(d.repartition(5), shards=shards, block_words=block).collect()
    key = lambda r: (r.row_a, r.row_b, tuple(tuple(c) for c in r.copies))
    assert sorted(map(key, mixed)) == sorted(map(key, again))


def test_mixing_hot_rows(spark):
    """A third of the rows alike: ordered as one, each dealt its own words."""
    d = spark.createDataFrame([(7, "same text here", "s")] * 400 + [(None, f"t{i} x", "s") for i in range(400)] + [(i, "y " * (i % 5), "t") for i in range(400)], "doc_id long, text string, source string")
    mixed = mixing.mix(d, weights=(1.0,), block_words=50)
    rows = mixed.collect()
    assert len(rows) == 1200 and sum(c["words"] for r in rows for c in r.copies) == sum(math.floor(t + 0.5) for t in {r.source: r.target for r in rows}.values())
    out = mixing.expand(d, mixed, 16)
    count = lambda t: len(re.findall(common.WORD, t))
    assert sum(count(r.text) for r in out.collect()) == sum(c["words"] for r in rows for c in r.copies)


def test_mixing_cuts_keep_white_space(spark):
    d = spark.createDataFrame([(i, f"a  b\n\tc{i}   d", "s") for i in range(5)], "doc_id long, text string, source string")
    texts = [r.text for r in mixing.expand(d, mixing.mix(d, share=0.9, weights=(1.0,)), 16).collect()]
    assert len(texts) == 5 and sum(any(t == f"a  b\n\tc{i}   d"[: len(t)] for i in range(5)) for t in texts) == 5 and sum(len(t.split()) for t in texts) == 18


def test_url_classes_by_brute_force(spark):
    rng = np.random.default_rng(4)
    urls = [f"http://h{i % 40}.example/p{i}" for i in range(200)]
    pages, pairs = [], []
    for i, u in enumerate(urls):
        tags = []
        for _ in range(rng.integers(0, 3)):
            to = urls[rng.integers(0, 200)] if rng.random() < 0.6 else None
            if to:
                tags.append(f'<link rel="canonical" href="{to}">' if rng.random() < 0.5 else f"<meta http-equiv=refresh content=\"0; url='{to}'\">")
                pairs.append((u, to))
            else:
                tags.append(f'<!-- <link rel="canonical" href="{urls[rng.integers(0, 200)]}"> -->')
        pages.append((i, u, "<head>" + "".join(tags), 1, "n", "v", True))
    pages += [pages[0], pages[0], (None, None, None, 1, "n", "v", True)]
    rules = [("h1.example/", "block"), ("h2.example/p2", "block"), ("h3.example/", "allow"), ("h30.example/p7", "allow"), ("h5.example/", "block")]
    parent = {u: u for u in urls}

    def find(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for a, b in pairs:
        parent[find(a)] = find(b)
    own = {}
    for u in urls:
        fit = [(r, v) for r, v in rules if re.match(rf"http://(?:[^/]*\.)?{re.escape(r)}", u)]
        own[u] = max(fit, key=lambda x: len(x[0]), default=None)
    of_class = defaultdict(set)
    for u in urls:
        if own[u]:
            of_class[find(u)].add(own[u][1])
    d = spark.createDataFrame(pages, "page_id long, url string, html string, id long, node string, rule string, moved boolean")
    got = url_filters.filter_urls(d, common.literal_table(spark, rules, ["rule", "action"])).collect()
    assert len(got) == len(pages)
    for r in got:
        if r.page_id is None:
            assert (r.host, r.verdict, r.decided_by) == ("", "allow", "default")
            continue
        u = urls[r.page_id]
        said = of_class[find(u)]
        want = own[u][1] if own[u] else "allow" if "allow" in said or not said else "block"
        assert (r.rule, r.verdict) == (own[u] and own[u][0], want)
        assert r.decided_by == ("rule" if own[u] else "alias class" if said else "default")


REFERENCES = [
    ('<link rel=canonical href="?x=1">', {"http://h.example/a/b?x=1"}),
    ('<link rel=canonical href="../c">', {"http://h.example/c"}),
    ('<link rel=canonical href="//o.example/z">', {"http://o.example/z"}),
    ('<link rel=canonical href="/login?next=http://bad.example/">', {"http://h.example/login?next=http://bad.example/"}),
    ('<base href="http://o.example/d/"><link rel=canonical href="e">', {"http://o.example/d/e"}),
    ('<link rel=canonical href="/1"><link rel=canonical href="/2">', {"http://h.example/1", "http://h.example/2"}),
    ('<!-- <link rel=canonical href="/1"> --><script>var t = "<link rel=canonical href=/2>"</script>', set()),
    ('<!-- never closed <link rel=canonical href="/1">', set()),
    ('<link rel=canonical href="http://[bad/">', set()),
    ("<meta http-equiv=refresh content=\"3; url='/1' \">", {"http://h.example/1"}),
]


def test_url_references(spark):
    rows = [(n, f"http://h{n}.example/a/b?q", html) for n, (html, _) in enumerate(REFERENCES)]
    got = defaultdict(set)
    for r in url_filters.page_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r.url].add(r.target)
    assert [got[u] for _, u, _ in rows] == [{t.replace("/h.", f"/h{n}.") for t in want} for n, (_, want) in enumerate(REFERENCES)]


def test_licenses_wrapped(spark):
    text = dict((i, t) for i, t in reversed(KNOWN) if len(t) > 400)
    rows = []
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib"):
        for width in (17, 40, 66, 72, 80):
            lines, line = [], ""
            for w in text[name].split():
                if len(line) + len(w) >= width and line:
                    lines.append(line)
                    line = ""
                line += w + " "
            rows.append((name, "Copyright (c) 2019-2021 Some One\n(c) 2020 Other\n\n" + "\n".join([*lines, line])))
    d = docs(spark, [(n, t, "en", "s") for n, (_, t) in enumerate(rows)] + HARD)
    found = license_scan.scan_licenses(d.withColumn("digest", F.lit(1)).withColumn("license_id", F.lit(2)), license_scan.known_digests(spark)).collect()
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append(r.license_id)
    assert len(found) == len(rows) + len(HARD)
    assert [got[n][0] for n in range(len(rows))] == [i for i, _ in rows]
    assert got[None] == [None] and sum(r.license_id is None for r in found) == len(HARD)


def test_quality_by_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = ["Some prose. It has sentences, and words in them.", "### $$$ ||| !!! ~~~ ###", "", None, "X9 " * 30]
    rows = [(i % 50 if i % 7 else None, texts[rng.integers(0, 5)], ["en", "de", None][rng.integers(0, 3)], [f"s{j}" for j in range(6)][min(5, i % 11)] if i % 13 else None, "a", "b", "c", 1) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _host string, global_share string, host_share string, _q_doc int")
    model = quality.Model([0.0] * 19, [1.0] * 19, [0.05 * ((-1) ** j) for j in range(19)], 0.1)
    got = quality.judge(d, model)
    assert set(got.columns) == {*d.columns, "_q_host", "_q_path", "_q_share", "_q_keep"} and got.select("_q_host", "_host", "global_share").count() == 400
    p = [1 / (1 + math.exp(-float(model.logit(np.array([quality.features(r[1])]))[0]))) for r in rows]
    path, host = defaultdict(list), defaultdict(list)
    for r, x in zip(rows, p, strict=True):
        path[r[3], r[2]].append(x)
        host[r[3]].append(x)
    m = sum(p) / len(p)
    inside = lambda x: min(max(x, 1e-3), 1 - 1e-3)

    def strength(groups, mean):
        own = sum(len(g) * (sum(g) / len(g) - mean(k)) ** 2 / (mean(k) * (1 - mean(k))) for k, g in groups.items())
        return 1 / min(max((own - len(groups)) / (sum(map(len, groups.values())) - len(groups)), 1 / 1001), 1 / 3) - 1

    sh = strength(host, lambda _: m)
    sp = strength(path, lambda k: inside((sum(host[k[0]]) + sh * m) / (len(host[k[0]]) + sh)))
    logit = lambda x: math.log(x / (1 - x))
    want = []
    for r, x in zip(rows, p, strict=True):
        h, g = host[r[3]], path[r[3], r[2]]
        hs = (sum(h) - x + sh * m) / (len(h) - 1 + sh)
        ps = (sum(g) - x + sp * hs) / (len(g) - 1 + sp)
        want.append((round(x, 6), round(hs, 6), round(ps, 6), round(1 / (1 + math.exp(-(logit(x) + logit(inside(ps)) - logit(m)))), 6)))
    assert sorted(want) == sorted(tuple(round(r[c], 6) for c in ("_q_doc", "_q_host", "_q_path", "_q_share")) for r in got.collect())


def test_quality_of_a_single_row_is_its_own(spark):
    d = docs(spark, [(1, "Some prose. It has sentences.", "en", "alone")])
    model = quality.Model([0.0] * 19, [1.0] * 19, [0.01] * 19, 0.4)
    r = quality.judge(d, model).first()
    assert r["_q_share"] == pytest.approx(r["_q_doc"])


def test_quality_fit_of_repeated_ids(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = [(i % 40, ("prose and words. " if i % 2 else "### $$ || ") * (1 + i % 7)) for i in range(400)]
    a, b = (quality.fit(spark.createDataFrame(x, IDS).repartition(n), labels) for x, n in ((rows, 3), (rows[::-1], 7)))
    assert a == b


def _parts(t):
    return {p for p in re.split(r"\s*\n\s*|(?<=[.!?])\s+", t, flags=re.ASCII) if p}


def test_fingerprints_of_hard_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "STRETCH", 2)
    monkeypatch.setattr(fingerprints, "QUANTILES", 8)
    rng = np.random.default_rng(8)
    text = lambda i: " ".join(f"S{i} number {j}." for j in range(rng.integers(0, 6))) or None
    rows = [(i, text(i)) for i in [*BIG, 0, 1, 2, *range(100, 140)]] + [(None, text(i)) for i in range(40)] + [(7, f"Same id. Text {i % 25}.") for i in range(60)] + [(9, "All the same. Twice.")] * 30
    got = fingerprints.fingerprint_edits(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id long, a string")).collect()
    full = [(i, t or "") for i, t in rows]
    full.sort(key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for k, (i, t) in enumerate(full):
        nxt = full[(k + 1) % len(full)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append((i, hashlib.sha256(edited.encode()).hexdigest(), round(like(_parts(t), _parts(edited)), 9), round(like(_parts(t), _parts(nxt)), 9)))
    assert Counter(want) == Counter((r.doc_id, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)


def test_scope_releases(spark):
    with common.Scope() as s:
        a, b = common.cut(spark.range(3)), s.keep(common.cut(spark.range(4)))
    assert b.count() == 4
    with pytest.raises(Exception, match=r"(?i)not exist|FileNotFound|FAILED_READ"):
        a.count()
    common.release(b)


def test_pipeline_stages_by_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(100_000, "One of a kind. With words of its own, and more of them.", "en", "src0", 55), (100_001, "One of a kind. With words of its own, and more of them.", "en", "src1", 55)]
    d = d.unionByName(spark.createDataFrame(extra, d.schema))
    stages = dict(corpus_pipeline.STAGES)
    model = quality.fit(d, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in quality.judge(d, model).where("_q_keep").collect()}
    one = common.cut(stages["quality"](spark, d, sf))
    assert {r.doc_id for r in one.collect()} == kept and 0.5 * d.count() < len(kept) < d.count()
    two = common.cut(stages["near duplicates"](spark, one, sf))
    groups = exact_components([(r.doc_id, r.text) for r in one.collect()], 80)
    assert Counter(r.doc_id for r in two.collect()) == Counter(i for i, (_, c) in groups.items() if i == c)
    three = common.cut(stages["mixing"](spark, two, sf))
    words = lambda t: len(re.findall(common.WORD, t or ""))
    have, sizes = Counter(), Counter()
    text = {r.doc_id: r.text for r in two.collect()}
    for r in two.collect():
        sizes[r.source] += words(r.text)
    for r in three.collect():
        have[r.source] += words(r.text)
        assert text[r.doc_id].startswith(r.text) or text[r.doc_id].split()[: words(r.text)] == r.text.split()
    names = sorted(sizes)
    for name, t in zip(names, mixing.targets([sizes[n] for n in names], [[3.0, 1.0, 2.0][i % 3] for i in range(len(names))]), strict=True):
        assert abs(have[name] - t) <= 0.5
    four = stages["packing"](spark, three, sf).collect()
    rows = [(r.doc_id, r.text) for r in three.collect()]
    tokens = Counter(zip([i for i, _ in rows], [len(b) // 4 for b in packing.Encoder()([t for _, t in rows])], strict=True))
    assert Counter((r.doc_id, r.doc_tokens) for r in four if r.start == 0) == tokens and sum(r.length for r in four) == sum(n * c for (_, n), c in tokens.items())
