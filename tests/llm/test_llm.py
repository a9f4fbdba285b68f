import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import duck_rows, spark_rows
from spindrift.llm import ann, chat_format, common, compaction, components, fingerprints, license_scan, minhash_dedup, mixing, packing, quality, queries, url_filters
from spindrift.llm.license_texts import KNOWN, WHOLE
from spindrift.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, a string, size long, copies string, v string"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(60_000))


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), 1, "a", 2, "c", "v") for i, t, lang, src in rows], SCHEMA)


HARD = [(1, None, "en", "s0"), (2, "", None, None), (3, "one", "en", "s0"), (3, "one", "en", "s0"), (None, "no id here at all", "en", "s1"), (5, LONG, "en", "s1"), (6, "a b c d e f g. H i.\n\nJ k l", "de", "s2"), (7, "a b c d e f g. H i.\n\nJ k l", "de", "s2"), (8, " \t\n", "", "")]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    assert spark_rows(queries.queries()[name](spark, sf)) == duck_rows(queries.oracle_sql()[name], sf)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (None, 3)] + [(200, 300 + i) for i in range(50)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[349] == 200 and len(got) == 41 + 3 + 51
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def rule_of(url):
    u = url or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    host = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = re.match(r"[^/?#]*([^?#]*)", rest, re.S)[1]
    best = None
    for r, action in url_filters.RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[0])):
            best = (r, action)
    return host, path, best


def test_url_rules(spark, sf):
    rules = common.literal_table(spark, url_filters.RULES, ["rule", "action"])
    extra = [(900001, "http://EXAMPLE.org/es/x", ""), (900002, None, None), (900003, "no scheme", ""), (900004, "http://xexample.org/es/", ""), (900005, "http://a.com?x", "")]
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame(extra, "page_id long, url string, html string"))
    urls = {r.page_id: r.url for r in pages.collect()}
    got = by_id(url_filters.filter_urls(pages, rules), "page_id")
    for i, u in urls.items():
        host, path, best = rule_of(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0])
        assert not best or got[i].verdict == best[1]
    assert url_filters.filter_urls(pages.limit(0), rules).count() == 0


def test_url_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://bad.example/x", ""), (2, "http://b.example/2", link.format("http://bad.example/x")), (3, "http://c.example/3", '<meta http-equiv="refresh" content="0; url=http://b.example/2">'), (4, "http://d.example/4", ""), (5, "http://e.example/5", link.format("http://bad2.example/")), (6, "http://good.example/", link.format("http://e.example/5")), (7, "http://www.bad.example/x?utm_source=a", "")]
    rules = common.literal_table(spark, [("bad.example/x", "block"), ("bad2.example/", "block"), ("good.example/", "allow")], ["rule", "action"])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for forms, last in ((True, "block"), (False, "block")):  # a rule fits subdomains
        got = by_id(url_filters.filter_urls(pages, rules, normal_forms=forms), "page_id")
        assert [got[i].verdict for i in range(1, 8)] == ["block", "block", "block", "allow", "allow", "allow", last]
        assert got[2].decided_by == "alias class" and got[4].decided_by == "default"
    other = spark.createDataFrame([(1, "http://h.example/x.html?utm_source=a", None), (2, "http://www.h.example/x", None)], "page_id long, url string, html string")
    rule = common.literal_table(spark, [("www.h.example/", "block")], ["rule", "action"])
    assert [by_id(url_filters.filter_urls(other, rule, normal_forms=f), "page_id")[1].verdict for f in (True, False)] == ["block", "allow"]


def test_url_aliases_of_ordinary_html(spark):
    far = "http://bad.example/" + "p" * 3000
    to = "http://bad.example/x"
    forms = {
        to: ["<meta http-equiv=\"refresh\" content=\"0;url='{}'\">", "<META content='5; URL=\"{}\"' HTTP-EQUIV=Refresh />", "<meta http-equiv=refresh content=0;url={}>", "<meta http-equiv=refresh content='0; {}'>", "<link rel=canonical href={}>", "<link data-x='a>b'\n rel='x canonical' href = '{}'/>", "<link rel=icon href=/i><link rel=canonical><link rel=canonical href=' {} '>"],
        "http://bad.example/x;jsessionid=1?a=1&b=2": ['<meta http-equiv="refresh" content="0; url={}">'],
        "http://bad.example/x?a=1&copy=2&lt=3": ['<link rel="canonical" href="{}">'],
        "http://bad.example/q?to=http://other.example/": ['<link rel="canonical" href="{}">'],
        far: ["<link href={} rel=canonical>", '<meta content="0;url={}" http-equiv="refresh">'],
    }
    rows = [(n, f"http://h{n}.example/", "<p>" + f.format(u.replace("&", ("&amp;", "&#38;", "&#x26;")[n % 3])) + "</p>") for n, (u, f) in enumerate((u, f) for u, fs in forms.items() for f in fs)]
    rows += [(100, "http://raw.example/", '<link rel="canonical" href="http://bad.example/x?a=1&copy=2&lt=3">'), (101, "http://rel.example/a/b", '<link rel="canonical" href="/q?to=http://bad.example/x">')]
    rows += [(200, "http://no.example/1", '<meta http-equiv="refresh" content="5">'), (201, "http://no.example/2", '<link rel="stylesheet" href="http://bad.example/canonical">'), (202, "http://no.example/3", "<link " * 20_000 + "canonical"), (203, "http://no.example/4", None)]
    rows += [(300 + n, u, "") for n, u in enumerate(forms)]
    rules = common.literal_table(spark, [("bad.example/", "block")], ["rule", "action"])
    got = by_id(url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules), "page_id")
    assert {i: g.verdict for i, g in got.items()} == {i: "allow" if i in (101, 200, 201, 202, 203) else "block" for i in got} and len(got) == len(rows)
    links = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.target for r in url_filters.page_links(links).collect()} == {*forms, "http://rel.example/q?to=http://bad.example/x"}


def exact_components(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for a, b in {(a, b) for ids in where.values() for a in ids for b in ids if a < b}:
        c = len(sets[a] & sets[b])
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark, sf, percent=85):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    near = []
    for k in range(60):  # a chain-like family around the threshold
        w = list(base)
        for p in rng.integers(0, 300, 1 + k % 9):
            w[p] = f"n{k}_{p}"
        near.append((10_000 + k, " ".join(w)))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + near
    got = by_id(minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == exact_components(rows, percent)


def test_shingles_ignore_batching():
    texts = ["A b\tC d e f", "a B c D E F", "", None, "x", LONG, "é É a b c d"]
    alone = [shingle_sets([t])[0].tolist() for t in texts]
    assert [s.tolist() for s in shingle_sets(texts)] == alone and alone[0] == alone[1] and alone[2] == alone[3] == []


def test_mixing_targets():
    sizes = [100, 10, 50, 1000]
    t = mixing.targets(sizes, [3, 1, 2, 3])
    assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6 and all(x <= 2 * s for x, s in zip(t, sizes, strict=True))
    many = mixing.targets([i % 97 for i in range(50_000)], [3, 1, 2] * 16_667)
    assert abs(sum(many) - 1.5 * sum(i % 97 for i in range(50_000))) < 1e-3
    q = mixing.split_quotas([5, 0, 17, 100], 7, 3)
    assert q.sum(axis=0).tolist() == [5, 0, 17, 100] and np.ptp(q.sum(axis=1)) <= 3


def test_mixing(spark):
    d = docs(spark, HARD)
    mixed = mixing.mix(d, shards=4, block_words=1000)
    rows = mixed.collect()
    assert len(rows) == len(HARD) and mixing.mix(d.limit(0)).count() == 0
    taken = defaultdict(int)
    for r in rows:
        assert sum(c["words"] for c in r["copies"]) <= 2 * r["size"] and all(0 <= c["shard"] < 4 for c in r["copies"])
        taken[r["source"], r["target"]] += sum(c["words"] for c in r["copies"])
    assert all(abs(n - target) <= 0.5 for (_, target), n in taken.items())
    out = mixing.expand(d, mixed, 4)
    assert set(out.columns) == set(d.columns)
    words = lambda t: len(re.findall(common.WORD, t or ""))
    want, have = defaultdict(list), defaultdict(list)
    for r in rows:
        want[r.doc_id] += [c["words"] for c in r["copies"]]
    for r in out.collect():
        have[r.doc_id].append(words(r.text))
    assert {i: sorted(x) for i, x in want.items() if x} == {i: sorted(x) for i, x in have.items()} and have[None]
    same_id = docs(spark, [(1, "a b", "en", "s"), (1, "c d", "en", "s"), (1, "a b", "en", "t"), (1, "a b", "en", None)])
    found = mixing.expand(same_id, mixing.mix(same_id, weights=(1.0,)), 4).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {r.source: r.n for r in found} == {"s": 4, "t": 4, None: 4}


def test_mixing_shard_in_several_tasks(spark, monkeypatch):
    d = docs(spark, [(i, "a b c " * (i % 9), "en", "s") for i in range(300)]).repartition(3)
    mixed = mixing.mix(d, weights=(1.0,), share=1.0, shards=2, block_words=20)  # each document once
    one = mixing.expand(d, mixed, 2).collect()
    monkeypatch.setattr(mixing, "WORDS_A_TASK", 500)
    rows = mixing.expand(d, mixed, 2).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(tuple(r) for r in one) == sorted(tuple(r)[:-1] for r in rows)
    where = {r.doc_id: (r.copies[0].shard, r.copies[0].place) for r in mixed.collect() if r.copies}
    tasks = defaultdict(list)
    for r in rows:
        tasks[r.task].append(where[r.doc_id])
    assert len(tasks) > 2 and all(t == sorted(t) for t in tasks.values())


def test_mixing_many_sources(spark):
    d = spark.createDataFrame([(i, "a b c", f"s\"{i}\u00e9", i) for i in range(2500)], "doc_id long, text string, source string, size long")
    rows = mixing.mix(d, shards=4).collect()
    assert len(rows) == 2500 and sum(c["words"] for r in rows for c in r["copies"]) > 0
    assert all(abs(sum(c["words"] for c in r["copies"]) - r["target"]) <= 0.5 for r in rows)


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a:<b>\\ #"), (1, 3, "user", "tail"), (2, 0, None, "x"), (None, 0, "assistant", "nul"), (3, 0, "assistant", LONG)]
    ex = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = by_id(chat_format.read_back(ex), "conv_id")
    assert got[1].n_turns == 4 and got[1].loss_chars == 8 and got[1].loss_sha256 == hashlib.sha256(b"a:<b>\\ #").hexdigest()
    assert got[2].loss_chars == 0 and got[None].n_turns == 1 and got[3].loss_chars == len(LONG)
    whole = chat_format.expand_examples(ex.where("conv_id = 1")).collect()
    assert len(whole) == 1 and chat_format.unescape(whole[0].text[whole[0].loss_start : whole[0].loss_end]) == "a:<b>\\ #"
    assert chat_format.read_back(ex.limit(0)).count() == 0 and chat_format.expand_examples(ex.limit(0)).count() == 0
    for t in ("", "\\", "\\\\", "</turn>\n### user: x", queries.HARD_TEXT):
        assert chat_format.read_turns(chat_format.turn_text("r:#\\", t)[0]) == [("r:#\\", t)]


def test_licenses(spark):
    mit = KNOWN[0][1]
    british = mit.replace("Permission", "PERMISSION").replace("sublicense", "sublicense") + "\n\nCopyright (c) 2020 Someone"
    d = docs(spark, [(1, british, "en", "s"), (2, mit + " and more", "en", "s"), (3, "Released under the MIT Licence!", "en", "s"), *HARD[4:]])
    got = {r.doc_id: r.license_id for r in license_scan.scan_licenses(d, license_scan.known_digests(spark)).collect()}
    assert got[1] == "MIT" and got[2] is None and got[3] == "MIT" and got[8] is None


def test_licenses_whole_texts_and_phrases(spark):
    text = dict(KNOWN[:11])
    variants = [("MIT", KNOWN[0][1].replace("sublicense", "sub-license")), ("MIT", KNOWN[0][1].replace("sublicense", "sub license")), ("BSD-3-Clause", text["BSD-3-Clause"].replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")), ("BSD-2-Clause", "Copyright 2020 X\n" + text["BSD-2-Clause"].replace("COPYRIGHT HOLDERS AND", "COPYRIGHT OWNERS AND"))]
    whole = [(i, t.replace("[yyyy] [name of copyright owner]", "2021 Someone").replace("non-commercial", "noncommercial")) for i, t in WHOLE]
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0"} <= {i for i, _ in whole}
    rows = variants + whole + [(None, whole[0][1] + " and more"), (None, "per cent sub license")]
    got = {r.doc_id: r.license_id for r in license_scan.scan_licenses(docs(spark, [(n, t, "en", "s") for n, (_, t) in enumerate(rows)]), license_scan.known_digests(spark)).collect()}
    assert [got[n] for n in range(len(rows))] == [i for i, _ in rows]


def test_quality(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(d, labels.where("doc_id % 2 = 0"))
    held = quality.judge(d, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    right = held.agg(F.avg(((F.col("quality") == 1) == F.col("_q_keep")).cast("int")).alias("x"), F.sum((~F.col("_q_keep") & (F.col("quality") == 1)).cast("int")).alias("lost")).first()
    assert right.x >= 0.97 and right.lost <= 2
    hard = docs(spark, HARD)
    assert quality.judge(hard, model).count() == len(HARD) and quality.judge(hard.limit(0), model).count() == 0
    assert quality.judge(hard, quality.fit(hard, labels.limit(0))).where("not _q_keep").count() == 0


def test_quality_sites_by_shuffle(spark, monkeypatch):
    model = quality.fit(d := docs(spark, HARD), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    rows = lambda: sorted(repr(tuple(r)) for r in quality.judge(d, model).collect())
    broadcast = rows()
    monkeypatch.setattr(quality, "SITE_BYTES", -1)
    assert rows() == broadcast and len(broadcast) == len(HARD)


def test_site_posteriors_shrink(spark):
    rows = [("big", "p", 0.0)] * 500 + [("big2", "p", 1.0)] * 500 + [("tiny", "q", 0.0)]
    sites = quality.site_posteriors(spark.createDataFrame(rows, "h string, p string, x double"), "h", "p", "x")
    got = {r["_host"]: r for r in sites.select("_host", "m", quality.posterior()[1].alias("share")).collect()}
    assert got["big"].share < got["tiny"].share < got["tiny"].m


def test_ann(spark, sf):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    odd = spark.createDataFrame([(50_000, [0.0] * 64, 0), (50_001, None, 0), (50_002, [float("nan")] * 64, 0), (50_003, [1.0], 0), (None, [1.0] * 64, 0)], "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in ann.nearest(e.unionByName(odd)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), ann.unit(np.array([r.embedding for r in rows], dtype=float))
    hit = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        hit += len(set(ids[np.lexsort((ids, -s))[:5]]) & {v for v, _ in got[q]})
    assert hit >= 0.9 * 5 * len(got) and set(got) == set(ids[ids % 50 == 0])
    assert ann.nearest(e.limit(0)).count() == 0 and ann.nearest(e.where("vec_id in (0, 1, 2)")).count() == 2
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in ann.nearest(same).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_ann_repeated_ids(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    found = lambda t, **o: [tuple(r)[:4] for r in ann.nearest(t, **o).orderBy("query_id", "rank").collect()]
    ten = e.crossJoin(spark.range(10).select()).select("vec_id", "embedding")
    assert found(ten) == found(e) and {x[0] for x in found(ten)} == {0, 50, 100, 150, 200, 250, 300, 350, 400, 450}
    # Ids with several vectors, one of them with a third of the rows.
    mixed = e.unionByName(e.select((F.col("vec_id") % 7 * 50).alias("vec_id"), "embedding")).unionByName(e.select(F.lit(11).cast(e.schema["vec_id"].dataType).alias("vec_id"), "embedding"))
    rows = mixed.collect()
    ids, x = np.array([r.vec_id for r in rows]), ann.unit(np.array([r.embedding for r in rows], dtype=float))
    got = defaultdict(list)
    for q, _, v, s in found(mixed, parts=1):
        got[q].append((v, s))
    names, where = np.unique(ids, return_inverse=True)
    for q in names[names % 50 == 0]:
        best = np.full(len(names), -2.0)
        np.maximum.at(best, where, (x[ids == q] @ x.T).max(axis=0))
        best[names == q] = -2
        order = np.lexsort((names, -np.round(best, 9)))[:5]
        assert [s for _, s in got[q]] == pytest.approx(best[order]) and len({v for v, _ in got[q]}) == 5
        assert all(best[names == v][0] == pytest.approx(s) for v, s in got[q])


def test_compaction(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/t", small_bytes=1000, fanout=3)
    d = docs(spark, HARD)
    for _ in range(7):
        store.append(d)
    store.append(d.limit(0))
    before = len(store.manifest()["shards"])
    done = store.compact()
    assert len(done["shards"]) < before and all(len([s for s in done["shards"] if s["tier"] == t["tier"]]) < 3 for t in done["shards"])
    assert store.read().count() == 7 * len(HARD) and store.read(3).count() == 3 * len(HARD)
    assert sorted(store.read().columns) == sorted(d.columns)
    store.vacuum()
    assert store.read().count() == 7 * len(HARD)
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(store.manifest(done["version"] - 1), [], done["schema"])


def test_compaction_by_several_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = compaction.ShardStore(spark, f"file://{tmp_path}/t", small_bytes=1000, fanout=3, target_bytes=1)
    d = spark.range(20)
    with ThreadPoolExecutor(4) as pool:
        versions = sorted(m["version"] for m in pool.map(lambda _: store.append(d), range(8)))
    assert versions == list(range(1, 9)) and store.read().count() == 160 and len(store.manifest()["shards"]) == 8
    # All files are of the target size, so nothing is merged; the last three versions stay readable.
    assert store.compact()["version"] == 8
    small = compaction.ShardStore(spark, store.root, small_bytes=1000, fanout=3)
    assert small.compact()["version"] > 8
    small.vacuum(2)
    assert small.read().count() == 160 == small.read(small.versions()[-2]).count()


@pytest.mark.parametrize("limits", [{}, {"max_segments": 2}, {"capacity": 64, "max_segments": 3, "max_loss": 20}])
def test_packing(spark, sf, limits):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10_000, None), (10_001, ""), (10_002, LONG)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("loss", F.lit(15))
    got = packing.pack(d, loss_col="loss" if limits else None, **limits).collect()
    cap = limits.get("capacity", 4096)
    ids = dict(zip([i for i, _ in rows], packing.Encoder()([t for _, t in rows]), strict=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    for i, b in ids.items():
        spans = sorted((r.start, r.length) for r in pieces[i])
        assert spans[0][0] == 0 and sum(n for _, n in spans) == len(b) // 4 and all(a + n == c for (a, n), (c, _) in zip(spans, spans[1:], strict=False))
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        n = sum(r.length for r in s)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s[:-1])]).tolist() and (n == cap or n & (n - 1) == 0)
        assert len(s) <= limits.get("max_segments", 256) and sum(r.loss_tokens for r in s) <= limits.get("max_loss", cap)
    assert packing.pack(d.limit(0)).count() == 0


def test_encoder_is_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] + ["", "I'll don't <|endoftext|> ́x Á ΑΣ\x1c!\x1c!", "日本語 テスト 12345"]
    assert packing.Encoder()(texts) == [np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for x in texts]


def test_fingerprints(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = by_id(fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")))
    rows.sort()

    def parts(t):
        return {p for p in re.split(r"\s*\n\s*|(?<=[.!?])\s+", t, flags=re.ASCII) if p}

    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = parts(t), parts(edited), parts(nxt)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 1e-12 and abs(got[i].near_next - len(a & c) / len(a | c)) < 1e-12
    hard = fingerprints.fingerprint_edits(docs(spark, HARD)).collect()
    assert len(hard) == len(HARD)
    text = {r.doc_id: r.fingerprint for r in hard}
    assert text[6] == text[7] and text[1] == text[2] == text[8]
    assert fingerprints.fingerprint_edits(docs(spark, HARD).limit(0)).count() == 0


def test_pipeline_of_hard_rows(spark, sf):
    hard = docs(spark, HARD).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        some = stage(spark, hard, sf)
        assert some.count() > 0 and (name == "packing" or some.columns == hard.columns)
        assert stage(spark, hard.limit(0), sf).count() == 0
