"""Queries of ingest, chunking, search, fusion, reranking, query generation and context assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions import text as T
from spindrift.operators import chunking, context, dense, fusion, ingest, querygen, sparse, tokens, vector_graph, vector_index
from spindrift import chain
from spindrift.functions import tables as table_functions
from spindrift.plans.base import SQL_DOT, registry, sql_bm25, sql_strip, sql_tokens, table
from spindrift.sources import tailing
from spindrift.tables import adopt, fresh, reading, release

QUERIES, ORACLES, query = registry()


@query("SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src3') AND lang IN ('en', 'fr') AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def filter_by_source_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = ingest.filter_repos(table(spark, d, "documents"), ["src1", "src3"], "source").where(F.col("lang").isin("en", "fr"))
    return ingest.filter_ids(docs, exclude=table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), col="doc_id").select("doc_id", "source", "lang")


@query(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(trim(text)) > 0 THEN NULL ELSE 'missing text' END, CASE WHEN n_chars = length(text) THEN NULL ELSE 'bad n_chars' END, CASE WHEN n_chars >= 200 THEN NULL ELSE 'short' END, CASE WHEN contains(text, ' ') THEN NULL ELSE 'one word' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents WHERE errors <> ''""")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    rules = {"missing text": F.length(F.trim("text")) > 0, "bad n_chars": F.col("n_chars") == F.length("text"), "short": F.col("n_chars") >= 200, "one word": F.contains(F.col("text"), F.lit(" "))}
    return ingest.invalid(table(spark, d, "documents"), rules, "doc_id").select("doc_id", F.array_join("errors", ",").alias("errors"))


@query("""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN place <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN place <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM p""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return ingest.stratified_split(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents GROUP BY 1")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


@query(f"SELECT count(*) AS chunks, sum(n)::BIGINT AS total_tokens, round(avg(n), 6) AS avg_tokens, min(n) AS min_tokens, max(n) AS max_tokens FROM (SELECT len({sql_tokens('text')}) AS n FROM documents)")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return sparse.token_stats(table(spark, d, "documents"))


_LINES = f"""w AS (SELECT doc_id, ls, unnest(range(0, len(ls), 40)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
c AS (SELECT doc_id, pos + 1 AS start_line, least(pos + 50, len(ls)) AS end_line, array_to_string(ls[pos + 1 : pos + 50], chr(10)) AS content FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS chunk FROM c WHERE length({sql_strip('content')}) >= 100)"""


@query(f"WITH {_LINES} SELECT doc_id, chunk, start_line, end_line, md5(content) AS content_md5 FROM k")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_chunks(table(spark, d, "documents")).select("doc_id", "chunk", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query(f"""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 1000) / 800.0), 0)::BIGINT + 1)) * 800 AS start FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, start, substr(text, start + 1, 1000) AS content FROM w)
SELECT doc_id, start, md5(content) AS content_md5 FROM c WHERE length({sql_strip('content')}) >= 100""")
def char_chunks_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.char_chunks(table(spark, d, "documents")).select("doc_id", "start", F.md5("content").alias("content_md5"))


#: Ends of windows, step by step: i and n are a boundary's place from the end of the last fifth and its length, f its place, e the end so far.
_KINDS = (("chr(10) || chr(10)", 2), ("chr(10)", 1), ("' .'", 2), ("' '", 1))
_SEEN = ", ".join(f"instr(reverse(substr(text, pos + 801, whole + {n} - pos - 800)), {b}) AS i{j}, length(substr(text, pos + 801, whole + {n} - pos - 800)) AS n{j}" for j, (b, n) in enumerate(_KINDS))
_PLACED = ", ".join(f"CASE WHEN i{j} > 0 AND whole < length(text) THEN pos + 800 + n{j} - i{j} + 1 - {n} ELSE -1 END AS f{j}" for j, (_, n) in enumerate(_KINDS))


def _ends(pos: str) -> str:
    """FROM clause with doc_id, text, pos and e of the windows that start at pos."""
    rows = f"(SELECT *, whole AS e FROM (SELECT *, {_PLACED} FROM (SELECT *, {_SEEN} FROM (SELECT *, least(pos + 1000, length(text)) AS whole FROM ({pos})))))"
    for j, (_, n) in enumerate(_KINDS):
        rows = f"(SELECT * REPLACE (CASE WHEN f{j} > pos + 800 AND f{j} < e THEN f{j} + {n} ELSE e END AS e) FROM {rows})"
    return rows


_CUTS = f"""w AS (SELECT doc_id, text, pos, e FROM {_ends("SELECT doc_id, text, 0::BIGINT AS pos FROM documents WHERE length(text) > 0")}
  UNION ALL SELECT doc_id, text, pos, e FROM {_ends("SELECT doc_id, text, greatest(e - 200, pos + 1) AS pos FROM w WHERE e < length(text)")})"""


@query(rf"""WITH RECURSIVE {_CUTS} SELECT doc_id, pos::INT AS start, substr(text, pos + 1, e - pos) AS content FROM w WHERE length({sql_strip("substr(text, pos + 1, e - pos)")}) >= 100""")
def char_chunks_boundary(spark: SparkSession, d: str) -> DataFrame:
    return chunking.boundary_chunks(table(spark, d, "documents"))


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def code_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", T.code_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("SELECT doc_id, length(text) // 4 AS tokens, md5(substr(text, 1, 400)) AS head_md5, md5(CASE WHEN length(text) <= 400 THEN text ELSE substr(text, length(text) - 399) END) AS tail_md5, (greatest(ceil((length(text) - 2000) / 1600.0), 0) + 1)::BIGINT AS pieces FROM documents")
def token_estimate_truncate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.token_count(c).alias("tokens"), F.md5(T.truncate(c, 100)).alias("head_md5"), F.md5(T.truncate(c, 100, "left")).alias("tail_md5"), F.size(T.windows(c, 2000, 400)).cast("long").alias("pieces"))


def _bm25(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return sparse.search(table(spark, d, "documents"), table(spark, d, "benchmark"), k)


@query(f"WITH {sql_bm25()} SELECT query, doc, score, rank FROM bm25")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("query", "doc", "score", "rank")


_PAGES = r"SELECT page_id AS doc, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages"


@query(f"""WITH {sql_bm25(_PAGES, name='b', k=20, weights=(('body', 1), ('title', 3)))},
x AS (SELECT b.query, b.doc, round(b.score * CASE WHEN contains(lower(p.title), lower(regexp_extract(q.text, '^[a-zA-Z]+', 0))) THEN 3 ELSE 1 END, 6) AS score FROM b JOIN ({_PAGES}) p ON p.doc = b.doc JOIN benchmark q ON q.item_id = b.query)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM x QUALIFY rank <= 10""")
def bm25_field_boost(spark: SparkSession, d: str) -> DataFrame:
    """Twice as many hits as wanted, three times the score if the title holds the query's first word, ranked again."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("body"))
    asked = table(spark, d, "benchmark")
    hits = sparse.search(pages, asked, 20, "page_id", {"body": 1, "title": 3}).drop("rank")
    first = asked.select(F.col("item_id").alias("query"), F.lower(F.regexp_extract("text", "^[a-zA-Z]+", 0)).alias("word"))
    both = hits.join(pages.select(F.col("page_id").alias("doc"), F.lower("title").alias("title")), "doc").join(first, "query")
    boosted = both.select("query", "doc", F.round(F.col("score") * F.when(F.contains(F.col("title"), F.col("word")), 3).otherwise(1), 6).alias("score"))
    return sparse.top_k(boosted, 10).select("query", "doc", "score", "rank")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the first of each label as queries."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"), "label")
    return rows, rows.groupBy(F.col("label").alias("qlabel")).agg(F.min_by("v", "doc").alias("qv"), F.min("doc").alias("query"))


_Q = "q AS (SELECT label AS qlabel, min(vec_id) AS query, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY 1)"
_TOP = "row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank"
_IP = f"round({SQL_DOT.format(a='embedding', b='qv')}, 6)"
_L2 = "round(-list_sum(list_transform(list_zip(embedding, qv), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 6)"


@query(f"WITH {_Q} SELECT query, vec_id AS doc, {_IP} AS score, {_TOP} FROM embeddings, q QUALIFY rank <= 10")
def dense_topk_ip(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(*_vectors(spark, d)).select("query", "doc", "score", "rank")


@query(f"WITH {_Q} SELECT query, vec_id AS doc, {_L2} AS score, {_TOP} FROM embeddings, q QUALIFY rank <= 10")
def dense_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(*_vectors(spark, d), metric="l2").select("query", "doc", "score", "rank")


@query(f"WITH {_Q} SELECT query, doc, score, rank FROM (SELECT query, qlabel, label, vec_id AS doc, {_IP} AS score, {_TOP} FROM embeddings, q QUALIFY rank <= 200) WHERE label <> qlabel")
def similar_exclude_label(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(*_vectors(spark, d), k=200, keep=F.col("label") != F.col("qlabel"), limit_first=True).select("query", "doc", "score", "rank")


def _stored(spark: SparkSession, d: str) -> str:
    """An index of the embeddings, saved; read back by its path."""
    path = fresh(spark, "vectors")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"), "label")
    vector_index.build(rows, path, cells=CELLS, model="given")
    return path


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))


CELLS = 32
_ASKED_VECTORS = "q AS (SELECT vec_id AS query, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0)"


@query(f"WITH {_ASKED_VECTORS} SELECT query, vec_id AS doc, label, {_IP} AS score, {_TOP} FROM embeddings, q QUALIFY rank <= 10")
def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """A saved index, loaded and searched by bounds of its cells: the rows of the search of all."""
    path = _stored(spark, d)
    out = vector_index.search(vector_index.VectorIndex.load(spark, path), _asked_vectors(spark, d), probe=8, exact=True)
    return adopt(out.select("query", "doc", "label", "score", "rank"), path)


@query(f"WITH {_ASKED_VECTORS} SELECT query, vec_id AS doc, label, {_L2} AS score, {_TOP} FROM embeddings, q QUALIFY rank <= 10")
def vector_index_l2(spark: SparkSession, d: str) -> DataFrame:
    path = _stored(spark, d)
    out = vector_index.search(vector_index.VectorIndex.load(spark, path), _asked_vectors(spark, d), probe=8, metric="l2", exact=True)
    return adopt(out.select("query", "doc", "label", "score", "rank"), path)


@query()
def vector_index_probe(spark: SparkSession, d: str) -> DataFrame:
    """A saved index, the nearest cells only; its recall is tested against the exact search."""
    path = _stored(spark, d)
    out = vector_index.search(vector_index.VectorIndex.load(spark, path), _asked_vectors(spark, d), probe=20)
    return adopt(out.select("query", "doc", "score", "rank"), path)


@query()
def dense_ivf(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    return dense.ivf_search(rows.select("doc", "v"), asked, lists=20, probe=5)


@query("SELECT max(len(embedding)) AS dim, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS mean_norm FROM embeddings")
def embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    return dense.stats(table(spark, d, "embeddings"), "embedding")


def _two_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sparse and dense lists of 30 for each item; its query vector is that of the same id."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    asked = table(spark, d, "benchmark").join(rows, F.col("item_id") == F.col("doc")).select(F.col("item_id").alias("query"), F.col("v").alias("qv"))
    return fusion.label({"sparse": _bm25(spark, d, 30), "dense": dense.search(rows, asked, 30)})


_LISTS = f"""{sql_bm25(k=30)}, dn AS (SELECT item_id AS query, e.vec_id AS doc, {SQL_DOT.format(a='e.embedding', b='q.embedding')} AS s FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings e),
d30 AS (SELECT query, doc, round(s, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(s, 6) DESC, doc) AS rank FROM dn QUALIFY rank <= 30),
hits AS (SELECT query, doc, score, rank, 'sparse' AS retriever, 0 AS position FROM bm25 UNION ALL SELECT query, doc, score, rank, 'dense', 1 FROM d30)"""


@query(f"WITH {_LISTS}, f AS (SELECT query, doc, round(sum(CASE retriever WHEN 'sparse' THEN 0.5 ELSE 0.5 END / (60 + rank)), 6) AS score FROM hits GROUP BY 1, 2) SELECT *, {_TOP} FROM f QUALIFY rank <= 10")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_two_lists(spark, d), 10, {"sparse": 0.5, "dense": 0.5})


@query(f"""WITH {_LISTS}, n AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w - min(score) OVER w AS span FROM hits WINDOW w AS (PARTITION BY query, retriever)),
f AS (SELECT query, doc, round(sum(CASE retriever WHEN 'sparse' THEN 0.4 ELSE 0.6 END * (score - lo) / CASE WHEN span = 0 THEN 1 ELSE span END), 6) AS score FROM n GROUP BY 1, 2) SELECT *, {_TOP} FROM f QUALIFY rank <= 10""")
def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.weighted_sum(_two_lists(spark, d), 10, {"sparse": 0.4, "dense": 0.6})


@query(f"""WITH {_LISTS}, f AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query, doc ORDER BY rank, position) = 1)
SELECT query, doc, score, retriever, row_number() OVER (PARTITION BY query ORDER BY rank, position) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, position) <= 10""")
def hybrid_interleave(spark: SparkSession, d: str) -> DataFrame:
    return fusion.interleave(_two_lists(spark, d), 10)


_WORDS = r"list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*') AND length(w) > 2 AND lower(w) NOT IN (" + ", ".join(f"'{w}'" for w in querygen.STOP_WORDS) + "))"
_KW = "list_filter({w}, lambda x, i: list_position(list_transform({w}, lambda y: lower(y)), lower(x)) = i)"


def _kw(x: str) -> str:
    return _KW.format(w=_WORDS.format(x=x))


_VARIANTS = f"""v AS (SELECT item_id AS query, 0 AS variant, 1.0 AS weight, text FROM benchmark UNION ALL SELECT item_id, 1, 1.5, array_to_string((kw)[1:8], ' ') FROM (SELECT item_id, {_kw('text')} AS kw FROM benchmark)),
{sql_bm25(asked="SELECT query * 2 + variant AS query, text FROM v", name='b', k=10)}, h AS (SELECT v.query, variant, weight, doc, score, rank FROM b JOIN v ON b.query = v.query * 2 + variant)"""


def _variant_hits(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    one = items.select(F.col("item_id").alias("query"), F.lit(0).alias("variant"), F.lit(1.0).alias("weight"), "text")
    two = items.select(F.col("item_id").alias("query"), F.lit(1).alias("variant"), F.lit(1.5).alias("weight"), F.array_join(F.slice(querygen.keywords(F.col("text")), 1, 8), " ").alias("text"))
    v = one.unionByName(two).withColumn("key", F.col("query") * 2 + F.col("variant"))
    hits = sparse.search(table(spark, d, "documents"), v, 10, query_id="key").withColumnRenamed("query", "key")
    return hits.join(v.drop("text"), "key")


@query(f"WITH {_VARIANTS}, f AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 6) AS score FROM h GROUP BY 1, 2) SELECT *, {_TOP} FROM f QUALIFY rank <= 10")
def multi_query_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_variant_hits(spark, d).withColumn("retriever", F.col("variant").cast("string")), 10)


@query(f"WITH {_VARIANTS}, f AS (SELECT query, doc, round(score * weight, 6) AS score FROM h QUALIFY row_number() OVER (PARTITION BY query, doc ORDER BY variant, rank) = 1) SELECT *, {_TOP} FROM f QUALIFY rank <= 10")
def query_merge(spark: SparkSession, d: str) -> DataFrame:
    return fusion.merge_queries(_variant_hits(spark, d), 10)


def _with_tokens(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Hits with the tokens of both texts: of the documents that are hits, not of all."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", "n_chars")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), T.code_tokens(F.col("text")).alias("qt"))
    return _bm25(spark, d, k).join(docs, "doc").join(asked, "query").withColumn("dt", T.code_tokens(F.col("text"))).drop("text")


_OVERLAP = f"""o AS (SELECT b.query, b.doc, b.rank, x.n_chars, len(list_intersect(list_distinct({sql_tokens('q.text')}), {sql_tokens('x.text')})) / len(list_distinct({sql_tokens('q.text')})) AS raw FROM bm25 b JOIN documents x ON x.doc_id = b.doc JOIN benchmark q ON q.item_id = b.query)"""
_SCALE = "round(({x} - min({x}) OVER w) / CASE WHEN max({x}) OVER w - min({x}) OVER w = 0 THEN 1 ELSE max({x}) OVER w - min({x}) OVER w END, 6)"


@query(f"WITH {sql_bm25(k=50)}, {_OVERLAP}, s AS (SELECT query, doc, {_SCALE.format(x='raw')} AS score FROM o WINDOW w AS (PARTITION BY query)) SELECT query, doc, score, {_TOP} FROM s QUALIFY rank <= 20")
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rerank(_with_tokens(spark, d, 50), fusion.overlap_score(F.col("qt"), F.col("dt")), 50, 20).select("query", "doc", "score", "rank")


@query(f"""WITH {sql_bm25(k=50)}, {_OVERLAP}, s AS (SELECT query, doc, n_chars, {_SCALE.format(x='raw')} AS score FROM o WINDOW w AS (PARTITION BY query)),
t AS (SELECT *, {_TOP} FROM s QUALIFY rank <= 20), u AS (SELECT query, doc, {_SCALE.format(x='(1.0 / n_chars)')} AS score FROM t WINDOW w AS (PARTITION BY query)) SELECT query, doc, score, {_TOP} FROM u QUALIFY rank <= 5""")
def rerank_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Overlap on 50 hits, then brevity on the best 20."""
    steps = [(fusion.overlap_score(F.col("qt"), F.col("dt")), 50, 20), (F.lit(1.0) / F.col("n_chars"), 20, 5)]
    return fusion.cascade(_with_tokens(spark, d, 50), steps).select("query", "doc", "score", "rank")


@query(f"""WITH {sql_bm25(k=20)}, h AS (SELECT b.*, md5(x.text) AS key FROM bm25 b JOIN documents x ON x.doc_id = b.doc),
k AS (SELECT *, min(rank) OVER (PARTITION BY query, key) AS place FROM h QUALIFY row_number() OVER (PARTITION BY query, key ORDER BY score DESC, rank, doc) = 1)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY place, doc) AS rank FROM k""")
def dedup_hits(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.md5("text").alias("key"))
    return fusion.dedup(_bm25(spark, d, 20).join(keys, "doc"), ["key"]).select("query", "doc", "score", "rank")


def _generated(problems: DataFrame, *strategies: str) -> DataFrame:
    return querygen.generate(problems, strategies=strategies, original=False).select("item_id", "ordinal", "query_text", "query_type", "weight", "source")


def _problems(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts, and turns of conversations made into reports of errors."""
    told = F.concat(F.lit('File "/srv/mod_'), (F.col("conv_id") % 7).cast("string"), F.lit('.py", line '), F.col("turn").cast("string"), F.lit(": loadItem raises "), F.element_at(F.array(F.lit("ValueError"), F.lit("KeyError"), F.lit("Exception")), (F.col("turn") % 3 + 1).cast("int")), F.lit(' "decode failed at '), F.col("role"), F.lit('" in core.parse_row. How to fix handlers? Must add retry')) 
    errors = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000).alias("item_id"), told.alias("text"))
    return table(spark, d, "benchmark").select("item_id", "text").unionByName(errors)


_PROBLEMS = """b AS (SELECT item_id, text FROM benchmark UNION ALL SELECT conv_id * 1000 + turn + 1000000, 'File "/srv/mod_' || conv_id % 7 || '.py", line ' || turn || ': loadItem raises ' || ['ValueError', 'KeyError', 'Exception'][turn % 3 + 1] || ' "decode failed at ' || role || '" in core.parse_row. How to fix handlers? Must add retry' FROM conversations)"""
_FIRST = "list_filter({w}, lambda x, i: list_position({w}, x) = i)"
#: Rows (item_id, pos, query_text, query_type, weight, source) of each strategy over b; pos is the place among all strategies.
_IN_ACTIONS = "lower(w) IN (" + ", ".join(f"'{w}'" for w in querygen.ACTIONS) + ")"
_STRATEGY = {
    "keywords": f"""kw AS (SELECT item_id, {_kw('text')} AS kw FROM b), ka AS (SELECT *, list_filter(kw, lambda w: {_IN_ACTIONS}) AS acts, list_filter(kw[1:5], lambda w: NOT {_IN_ACTIONS}) AS others FROM kw),
g_keywords AS (SELECT item_id, 1 AS pos, array_to_string(kw[1:8], ' ') AS query_text, 'keywords' AS query_type, 1.5::DOUBLE AS weight, 'keyword_extraction' AS source FROM ka WHERE len(kw) > 0
  UNION ALL SELECT item_id, 2, acts[1] || ' ' || array_to_string(others[1:2], ' '), 'action_keywords', 1.8::DOUBLE, 'keyword_extraction' FROM ka WHERE len(acts) > 0 AND len(kw) > 1 AND len(others) > 0)""",
    "code_symbols": rf"""sy0 AS (SELECT item_id, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda s: regexp_full_match(s, '[a-z][a-z0-9_]*[a-z0-9]') AND (contains(s, '_') OR length(s) > 5)) || list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda s: regexp_full_match(s, '[a-zA-Z][a-zA-Z0-9]*[a-z][A-Z][a-zA-Z0-9]*')) || list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+(?:\.[\p{{L}}\p{{N}}_]+)+'), lambda s: regexp_full_match(s, '[a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)+')) AS w FROM b),
sy AS (SELECT item_id, {_FIRST.format(w='w')} AS f FROM sy0), sc AS (SELECT *, list_filter(f, lambda s: contains(s, '_') OR regexp_matches(s, '^.+[A-Z]')) AS code FROM sy),
g_code_symbols AS (SELECT item_id, 3 AS pos, array_to_string(f[1:5], ' ') AS query_text, 'code_symbols' AS query_type, 1.3::DOUBLE AS weight, 'symbol_extraction' AS source FROM sc WHERE len(f) > 0 UNION ALL SELECT item_id, 4, 'def ' || code[1], 'function_search', 1.4::DOUBLE, 'symbol_extraction' FROM sc WHERE len(code) > 0)""",
    "error_patterns": r"""er AS (SELECT item_id, regexp_extract(text, '\b([A-Z][a-zA-Z]*Error|Exception|Warning|AssertionError)\b', 1) AS kind, regexp_extract(text, '(?i)["'']([^"'']*(?:error|exception|failed)[^"'']*)["'']', 1) AS said, regexp_extract(text, 'File "([^"]+)", line (\d+)', 1) AS path FROM b),
g_error_patterns AS (SELECT item_id, 5 AS pos, kind || ' handle catch' AS query_text, 'error_handling' AS query_type, 1.4::DOUBLE AS weight, 'error_extraction' AS source FROM er WHERE kind <> '' UNION ALL SELECT item_id, 6, 'raise ' || kind, 'error_source', 1.3::DOUBLE, 'error_extraction' FROM er WHERE kind <> ''
  UNION ALL SELECT item_id, 7, array_to_string(list_filter(string_split_regex(said, '\s+'), lambda w: w <> '')[1:5], ' '), 'error_message', 1.2::DOUBLE, 'error_extraction' FROM er WHERE said <> '' UNION ALL SELECT item_id, 8, replace(string_split(path, '/')[-1], '.py', '') || ' error', 'file_error', 1.3::DOUBLE, 'error_extraction' FROM er WHERE path <> '')""",
    "natural_language": rf"""nl AS (SELECT item_id, {sql_strip("string_split_regex(text, '[.!?]+')[1]")} AS s, regexp_extract(text, '(?i)(?:how|what|when|where)[ \t\n\f\r]+(?:to|do|is|are|does|can|should)[ \t\n\f\r]+(.+)', 1) AS how FROM b),
g_natural_language AS (SELECT item_id, 9 AS pos, substr(s, 1, 200) AS query_text, 'natural_language' AS query_type, 1.0::DOUBLE AS weight, 'reformulation' AS source FROM nl WHERE length(s) > 20 UNION ALL SELECT item_id, 10, 'how to ' || substr(how, 1, 100), 'how_to', 1.1::DOUBLE, 'reformulation' FROM nl WHERE how <> '')""",
    "action_focus": "ak AS (SELECT item_id, coalesce(" + ", ".join(rf"CASE WHEN len(regexp_extract_all(text, '{p}', 1)) > 0 THEN '{n} ' || array_to_string(regexp_extract_all(text, '{p}', 1)[1:3], ' ') END" for p, n in querygen.ASKS) + """) AS q FROM b),
g_action_focus AS (SELECT item_id, 11 AS pos, q AS query_text, 'action_focus' AS query_type, 1.2::DOUBLE AS weight, 'action_extraction' AS source FROM ak WHERE q IS NOT NULL)""",
}


def _sql_generated(base: str, *strategies: str, original: bool = False, most: int = 5) -> str:
    parts = ["SELECT item_id, 0 AS pos, text AS query_text, 'original' AS query_type, 1.0::DOUBLE AS weight, 'original' AS source FROM b"] * original + [f"SELECT * FROM g_{s}" for s in strategies]
    key = f"lower({sql_strip('query_text')})"
    return f"""WITH {base}, {', '.join(_STRATEGY[s] for s in strategies)}, g AS ({' UNION ALL '.join(parts)}), u AS (SELECT *, min(pos) OVER (PARTITION BY item_id, {key}) AS first FROM g QUALIFY row_number() OVER (PARTITION BY item_id, {key} ORDER BY weight DESC, pos) = 1)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, first) AS ordinal, query_text, query_type, weight, source FROM u QUALIFY ordinal <= {most}"""


_ITEMS = "b AS (SELECT item_id, text FROM benchmark)"


@query(_sql_generated(_ITEMS, "keywords"))
def keyword_queries(spark: SparkSession, d: str) -> DataFrame:
    return _generated(table(spark, d, "benchmark"), "keywords")


@query(_sql_generated(_PROBLEMS, "code_symbols"))
def symbol_queries(spark: SparkSession, d: str) -> DataFrame:
    return _generated(_problems(spark, d), "code_symbols")


@query(_sql_generated(_PROBLEMS, "error_patterns"))
def error_queries(spark: SparkSession, d: str) -> DataFrame:
    return _generated(_problems(spark, d), "error_patterns")


@query(_sql_generated(_ITEMS, "natural_language"))
def nl_queries(spark: SparkSession, d: str) -> DataFrame:
    return _generated(table(spark, d, "benchmark"), "natural_language")


@query(_sql_generated(_PROBLEMS, *querygen.STRATEGIES, original=True))
def generated_queries(spark: SparkSession, d: str) -> DataFrame:
    return querygen.generate(_problems(spark, d), strategies=tuple(querygen.STRATEGIES)).select("item_id", "ordinal", "query_text", "query_type", "weight", "source")


@query(f"SELECT item_id, substr({sql_strip('text')}, 1, 500) AS simple, array_to_string(({_kw('text')})[1:10], ' ') AS keyword FROM benchmark")
def plain_queries(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", querygen.simple_query(t).alias("simple"), querygen.keyword_query(t).alias("keyword"))


_VAR = f"""w AS (SELECT item_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws, regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*') AS terms FROM benchmark),
c AS (SELECT *, list_filter(ws, lambda x: lower(x) NOT IN ({', '.join(f"'{x}'" for x in querygen.SEARCH_STOPS)})) AS content, list_filter(ws, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in querygen.SEARCH_ACTIONS)})) AS acts FROM w),
l AS (SELECT item_id, list_filter([text, CASE WHEN len(content) > 0 AND len(content) < len(ws) THEN array_to_string(content, ' ') END, CASE WHEN len(terms) >= 2 THEN array_to_string(terms, ' ') END, CASE WHEN len(acts) > 0 THEN array_to_string(acts || terms[1:3], ' ') END], lambda x: x IS NOT NULL)[1:3] AS vs FROM c),
va AS (SELECT item_id, unnest(range(len(vs))) AS variant, unnest(vs) AS text FROM l)"""


@query(f"WITH {_VAR} SELECT item_id, variant, text FROM va")
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    return querygen.variants(table(spark, d, "benchmark"))


@query(f"""WITH {_VAR}, {sql_bm25(asked="SELECT item_id * 10 + variant AS query, text FROM va", name='b', k=10)}, h AS (SELECT item_id AS query, variant, doc, score, rank FROM b JOIN va ON b.query = item_id * 10 + variant),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query, doc ORDER BY rank, variant) = 1)
SELECT query, doc, score, variant::VARCHAR AS retriever, row_number() OVER (PARTITION BY query ORDER BY rank, variant) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, variant) <= 10""")
def variant_interleave(spark: SparkSession, d: str) -> DataFrame:
    v = querygen.variants(table(spark, d, "benchmark")).withColumn("key", F.col("item_id") * 10 + F.col("variant"))
    hits = sparse.search(table(spark, d, "documents"), v, 10, query_id="key").withColumnRenamed("query", "key").join(v.select("key", F.col("item_id").alias("query"), "variant"), "key")
    return fusion.interleave_variants(hits, 10).select("query", "doc", "score", "retriever", "rank")


@query(f"WITH {sql_bm25()} SELECT query, doc, score, rank FROM bm25")
def bm25_saved_index(spark: SparkSession, d: str) -> DataFrame:
    """An index that is saved, loaded again and searched."""
    path = fresh(spark, "index")
    made = sparse.build(table(spark, d, "documents"))
    made.save(path)
    release(made.postings, made.terms, made.stats)
    return adopt(sparse.search_index(sparse.Index.load(spark, path), table(spark, d, "benchmark")).select("query", "doc", "score", "rank"), path)


@query()
def vector_graph_search(spark: SparkSession, d: str) -> DataFrame:
    """A walk over a graph of neighbours; its recall over all rows is tested against the exact search."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    graph = vector_graph.build(rows)
    found = vector_graph.search(rows, graph, _asked_vectors(spark, d))
    return adopt(found.select("query", "doc", "score", "rank", "scored"), *graph._cuts)


def _vocabulary(spark: SparkSession) -> tokens.Vocabulary:
    import public_tokenizers

    return tokens.Vocabulary.read(spark, "file://" + str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@query("SELECT doc_id, md5(coalesce(text, '')) AS rejoined_md5, length(coalesce(text, ''))::BIGINT AS covered, coalesce(text, '') = '' AS empty FROM documents")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 256 tokens: without overlap they rejoin to the text, with 32 tokens of overlap they cover it without a gap."""
    v, text = _vocabulary(spark), F.coalesce("text", F.lit(""))
    both = tokens.all_windows(text, {"plain": (256, 0), "lapped": (256, 32)}, v)
    cuts = table(spark, d, "documents").select("doc_id", text.alias("text"), both.alias("w")).select("doc_id", "text", "w.plain", "w.lapped")
    covered = F.aggregate("lapped", F.lit(0).cast("long"), lambda at, w: F.when(w["start"] <= at, F.greatest(at, w["stop"])).otherwise(at))
    return cuts.select("doc_id", F.md5(F.array_join(tokens.pieces(F.col("text"), F.col("plain")), "")).alias("rejoined_md5"), covered.alias("covered"), (F.size("plain") == 0).alias("empty"))


@query()
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each text, and the lengths of its first and last hundred; tested against the tokenizer's library."""
    t = table(spark, d, "documents").select("doc_id", tokens.count_and_cut(F.col("text"), 100, _vocabulary(spark)).alias("t"))
    return t.select("doc_id", "t.tokens", F.length("t.first").alias("first_chars"), F.length("t.last").alias("last_chars"))


@query(f"""WITH {sql_bm25(k=40)}, h AS (SELECT query, doc, score, rank AS r, md5(x.text) AS key FROM bm25 b JOIN documents x ON x.doc_id = b.doc WHERE score >= 2 AND doc % 3 <> 0),
k AS (SELECT query, doc, score FROM h QUALIFY row_number() OVER (PARTITION BY query, key ORDER BY score DESC, r, doc) = 1) SELECT query, doc, score, {_TOP} FROM k QUALIFY rank <= 10""")
def retrieve_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Search, filter by score and predicate, one hit of equal texts, limit."""
    docs = table(spark, d, "documents")
    key = docs.select(F.col("doc_id").alias("doc"), F.md5("text").alias("key"))
    return sparse.retrieve(sparse.build(docs), table(spark, d, "benchmark"), 10, 2.0, F.col("doc") % 3 != 0, key, fetch=40).select("query", "doc", "score", "rank")


@query("SELECT doc_id AS doc, count(*) AS terms, sum(tf)::BIGINT AS dl, (SELECT count(*) FROM documents) AS n_docs FROM (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(" + sql_tokens("text") + ") AS t FROM documents WHERE doc_id = 7) GROUP BY 1, 2) GROUP BY 1")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    index = sparse.build(table(spark, d, "documents"))
    found = index.lookup(7).groupBy("doc").agg(F.count("*").alias("terms"), F.sum("tf").alias("dl")).withColumn("n_docs", F.lit(index.documents()))
    return reading(found, index.postings, index.terms, index.stats)


_NAMED = r"SELECT page_id AS doc, regexp_extract(html, '<title>([^ <]*)', 1) AS name, regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1) AS imports FROM pages"


@query(rf"""WITH asked AS (SELECT item_id AS query, regexp_extract(text, '^[a-zA-Z]+', 0) || CASE WHEN item_id % 2 = 0 THEN '' ELSE ' zzz' END AS text FROM benchmark), {sql_bm25(_PAGES, asked='SELECT * FROM asked', name='b', k=20, weights=(('body', 1),))}, n AS ({_NAMED}),
x AS (SELECT b.query, b.doc, round(b.score * CASE WHEN name <> '' AND contains(lower(name), lower(asked.text)) THEN 3.0 ELSE 1.0 END * CASE WHEN len(imports) > 0 AND len(list_filter(string_split_regex(lower(asked.text), '\s+'), lambda w: w <> '' AND contains(lower(array_to_string(imports, ' ')), w))) > 0 THEN 0.5 ELSE 1.0 END, 6) AS score FROM b JOIN n USING (doc) JOIN asked ON asked.query = b.query)
SELECT query, doc, score, {_TOP} FROM x QUALIFY rank <= 10""")
def field_boost_imports(spark: SparkSession, d: str) -> DataFrame:
    """Three times the score if the page's name holds the query, half of it if its links hold a word of the query."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("body"), F.regexp_extract("html", "<title>([^ <]*)", 1).alias("name"), F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)).alias("imports"))
    word = F.regexp_extract("text", "^[a-zA-Z]+", 0)
    asked = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, word).otherwise(F.concat(word, F.lit(" zzz"))).alias("text"))
    hits = sparse.search(pages, asked, 20, "page_id", {"body": 1})
    return fusion.field_boost(hits, pages.select(F.col("page_id").alias("doc"), "name", "imports"), asked.select(F.col("item_id").alias("query"), "text"), 10).select("query", "doc", "score", "rank")


@query(f"WITH {_LISTS}, f AS (SELECT query, doc, round(sum(CASE retriever WHEN 'sparse' THEN 0.25 ELSE 0.75 END / (60 + rank)), 6) AS score, max(score) FILTER (retriever = 'sparse') AS sparse_score, max(score) FILTER (retriever = 'dense') AS dense_score FROM hits GROUP BY 1, 2) SELECT *, {_TOP} FROM f QUALIFY rank <= 10")
def hybrid_components(spark: SparkSession, d: str) -> DataFrame:
    """Fused lists with each list's own score; weights are made to sum to 1."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    asked = table(spark, d, "benchmark").join(rows, F.col("item_id") == F.col("doc")).select(F.col("item_id").alias("query"), F.col("v").alias("qv"))
    return fusion.hybrid({"sparse": _bm25(spark, d, 30), "dense": dense.search(rows, asked, 30)}, 10, {"sparse": 1, "dense": 3}).select("query", "doc", "score", "sparse_score", "dense_score", "rank")


@query("SELECT doc_id, md5('File: ' || source || CASE WHEN coalesce(lang, '') <> '' THEN ', Name: ' || lang ELSE '' END || chr(10) || 'Type: module' || chr(10) || 'Imports: ' || array_to_string(string_split(substr(text, 1, 60), ' ')[1:5], ', ') || chr(10) || 'Content:' || chr(10) || CASE WHEN length(text) > 412 THEN substr(text, 1, 412) || '...' ELSE text END) AS pair_md5 FROM documents")
def rerank_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = fusion.pair_text(F.col("source"), F.col("lang"), F.lit("module"), F.split(F.substring("text", 1, 60), " "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("pair_md5"))


def _common_length() -> "object":
    """The model of the query: a stand-in for one that would be loaded from a file."""
    return lambda qs, ts: [min(len(q), len(t)) / max(1, max(len(q), len(t))) for q, t in zip(qs, ts, strict=True)]


@query(f"""WITH {sql_bm25(k=20)}, r AS (SELECT query, doc, least(length(q.text), length(x.text)) / greatest(1, length(q.text), length(x.text)) AS raw FROM bm25 b JOIN documents x ON doc_id = doc JOIN benchmark q ON item_id = query),
s AS (SELECT query, doc, {_SCALE.format(x='raw')} AS score FROM r WINDOW w AS (PARTITION BY query)) SELECT *, {_TOP} FROM s QUALIFY rank <= 10""")
def rerank_model(spark: SparkSession, d: str) -> DataFrame:
    """A scorer that is loaded once in a worker and gets batches of pairs."""
    both = _bm25(spark, d, 20).join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("asked")), "query")
    return fusion.rerank(both, fusion.model_scorer(_common_length, F.col("asked"), F.col("text")), 20, 10).select("query", "doc", "score", "rank")


@query(f"""WITH {sql_bm25(k=20)}, p AS (SELECT query, doc, rank AS r, CASE WHEN rank <= 10 AND doc % 4 <> 0 THEN (doc % 11) / 10.0 ELSE score END::DOUBLE AS score FROM bm25)
SELECT query, doc, score, CASE WHEN r > 10 THEN r ELSE row_number() OVER (PARTITION BY query, r > 10 ORDER BY score DESC, doc) END AS rank FROM p""")
def rerank_points(spark: SparkSession, d: str) -> DataFrame:
    """Points out of ten for some of the first ten hits."""
    hits = _bm25(spark, d, 20).select("query", "doc", "score", "rank")
    points = hits.where("rank <= 10 and doc % 4 <> 0").select("query", "doc", (F.col("doc") % 11).alias("points"))
    return fusion.rerank_by_table(hits, points).select("query", "doc", "score", "rank")


def _counted() -> "object":
    return lambda texts: [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]


@query("SELECT doc_id, length(text)::DOUBLE AS a, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS b, (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS c FROM documents")
def encoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """An encoder that is loaded once in a worker and gets batches of texts."""
    v = table(spark, d, "documents").select("doc_id", dense.encode(_counted, F.col("text")).alias("v"))
    return v.select("doc_id", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"), F.get("v", F.lit(2)).alias("c"))


_TYPES = "CASE lang WHEN 'en' THEN 'file_content' WHEN 'de' THEN 'function_definition' WHEN 'fr' THEN 'documentation' ELSE 'related_code' END"
_ORDER = "CASE context_type WHEN 'error_context' THEN 0 WHEN 'function_definition' THEN 1 WHEN 'class_definition' THEN 2 WHEN 'file_content' THEN 3 WHEN 'related_code' THEN 4 WHEN 'test_code' THEN 5 WHEN 'documentation' THEN 6 END"


@query(f"""WITH {sql_bm25(k=50)}, h AS (SELECT query, doc, score, text AS content, {_TYPES} AS context_type, length(text) // 4 AS t FROM bm25 JOIN documents ON doc_id = doc),
r AS (SELECT *, sum(t) OVER (PARTITION BY query ORDER BY {_ORDER}, score DESC, doc ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY query ORDER BY {_ORDER}, score DESC, doc) AS place FROM h),
x AS (SELECT *, 8000 - (upto - t) AS room, upto > 8000 AND 8000 - (upto - t) >= 0 AND context_type = 'file_content' AND 8000 - (upto - t) > 200 AS truncated FROM r)
SELECT query, doc, place, context_type, truncated, (CASE WHEN truncated THEN least(length(content), room * 4) ELSE length(content) END // 4)::BIGINT AS tokens FROM x WHERE upto <= 8000 OR truncated""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content"), F.when(F.col("lang") == "en", "file_content").when(F.col("lang") == "de", "function_definition").when(F.col("lang") == "fr", "documentation").otherwise("related_code").alias("context_type"))
    return context.trim_to_budget(_bm25(spark, d, 50).drop("rank").join(docs, "doc"), 8000).select("query", "doc", "place", "context_type", "truncated", "tokens")


@query(f"""WITH {sql_bm25(k=50)}, {_OVERLAP}, s AS (SELECT query, doc, {_SCALE.format(x='raw')} AS score FROM o WINDOW w AS (PARTITION BY query)), tp AS (SELECT query, doc, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 20),
h AS (SELECT query, doc, score, text AS content, {_TYPES} AS context_type, length(text) // 4 AS t FROM tp JOIN documents ON doc_id = doc),
r AS (SELECT *, sum(t) OVER (PARTITION BY query ORDER BY {_ORDER}, score DESC, doc ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY query ORDER BY {_ORDER}, score DESC, doc) AS place FROM h),
x AS (SELECT *, 4000 - (upto - t) AS room, upto > 4000 AND 4000 - (upto - t) >= 0 AND context_type = 'file_content' AND 4000 - (upto - t) > 200 AS truncated FROM r)
SELECT query, doc, score, place, truncated, (CASE WHEN truncated THEN least(length(content), room * 4) ELSE length(content) END // 4)::BIGINT AS tokens FROM x WHERE upto <= 4000 OR truncated""")
def configured_chain(spark: SparkSession, d: str) -> DataFrame:
    """A chain by name, with one setting of its own: 50 hits, the best 20 by overlap, a budget of 4,000 tokens."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content"), F.when(F.col("lang") == "en", "file_content").when(F.col("lang") == "de", "function_definition").when(F.col("lang") == "fr", "documentation").otherwise("related_code").alias("context_type"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    made = chain.build({"chain": "reranked", "steps": {"context": {"max_tokens": 4000}}})
    return made.gather(docs, items).select("query", "doc", "score", "place", "truncated", "tokens")


@query("SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY 1")
def source_shares(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return n.select("source", "n", F.round(100.0 * F.col("n") / F.sum("n").over(whole), 6).alias("share"), F.row_number().over(Window.orderBy(F.desc("n"), "source")).alias("rank"))


_CHUNKS = """c AS (SELECT doc_id AS doc, doc_id % 20 AS query, source || '/' || lang || '.py' AS path, 1 AS start_line, len(string_split(text, chr(10))) AS end_line, text AS content, CASE doc_id % 8 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' WHEN 3 THEN 'import' WHEN 4 THEN 'test' WHEN 5 THEN 'error' WHEN 6 THEN 'module' ELSE 'other' END AS kind, ((doc_id * 37) % 101)::DOUBLE AS score FROM documents),
t AS (SELECT *, CASE kind WHEN 'function' THEN 'function_definition' WHEN 'method' THEN 'function_definition' WHEN 'class' THEN 'class_definition' WHEN 'import' THEN 'import_dependency' WHEN 'test' THEN 'test_context' WHEN 'error' THEN 'error_context' ELSE 'file_content' END AS context_type FROM c)"""
_CORE = "CASE context_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(context.CORE_PRIORITY)) + " END"
_PROMPT = "CASE context_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(context.PRIORITY)) + f" ELSE {len(context.PRIORITY)} END"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of twenty queries."""
    kinds = F.array(*map(F.lit, ["function", "method", "class", "import", "test", "error", "module", "other"]))
    c = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 20).alias("query"), F.concat("source", F.lit("/"), "lang", F.lit(".py")).alias("path"), F.lit(1).alias("start_line"), F.size(T.lines(F.col("text"))).alias("end_line"), F.col("text").alias("content"), F.element_at(kinds, (F.col("doc_id") % 8 + 1).cast("int")).alias("kind"), ((F.col("doc_id") * 37) % 101).cast("double").alias("score"))
    return c.withColumn("context_type", context.context_type(F.col("kind")))


@query(f"""WITH {_CHUNKS}, r AS (SELECT *, length(content) // 4 AS n, sum(length(content) // 4) OVER w AS upto, row_number() OVER w AS place FROM t WINDOW w AS (PARTITION BY query ORDER BY {_CORE}, score DESC, doc ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, 4000 - (upto - n) AS room, upto > 4000 AND 4000 - (upto - n) > 100 AND context_type = 'file_content' AS truncated FROM r)
SELECT query, doc, place, truncated, (CASE WHEN truncated THEN least(length(content), room * 4) ELSE length(content) END // 4)::BIGINT AS tokens FROM x WHERE upto <= 4000 OR truncated""")
def context_core(spark: SparkSession, d: str) -> DataFrame:
    return context.core_trim(_chunks(spark, d), 4000).select("query", "doc", "place", "truncated", "tokens")


_BLOCKS = f"""{_CHUNKS}, bl AS (SELECT *, '### ' || path || ' (lines ' || start_line || '-' || end_line || ')' || chr(10) || '```' || chr(10) AS head FROM t), bt AS (SELECT *, head || content || chr(10) || '```' AS whole, length(head || content || chr(10) || '```') // 4 AS n FROM bl),
br AS (SELECT *, sum(n) OVER w AS upto, row_number() OVER w AS place FROM bt WINDOW w AS (PARTITION BY query ORDER BY {_PROMPT}, score DESC, path, start_line ROWS UNBOUNDED PRECEDING)),
bx AS (SELECT *, 6500 - (upto - n) - length(head) // 4 - 1 AS free, upto > 6500 AND 6500 - (upto - n) >= 0 AND context_type = 'file_content' AS may FROM br),
by_ AS (SELECT *, may AND free >= 50 AS truncated, CASE WHEN may AND free >= 50 THEN head || substr(content, 1, (free * 4)::BIGINT) || CASE WHEN length(content) > free * 4 THEN chr(10) || '... [truncated]' ELSE '' END || chr(10) || '```' ELSE whole END AS block FROM bx WHERE upto <= 6500 OR (may AND free >= 50))"""


def _unlike(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose paths differ, so that their order is fixed."""
    return _chunks(spark, d).withColumn("path", F.concat("path", F.lit("#"), F.col("doc").cast("string")))


_BLOCKS = _BLOCKS.replace("source || '/' || lang || '.py' AS path", "source || '/' || lang || '.py#' || doc_id AS path")


@query(f"WITH {_BLOCKS} SELECT query, place, md5(block) AS block_md5, (length(block) // 4)::BIGINT AS tokens, truncated FROM by_")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    return context.prompt_blocks(_unlike(spark, d)).select("query", "place", F.md5("block").alias("block_md5"), "tokens", "truncated")


_ASKED = "p AS (SELECT item_id % 20 AS query, arg_min(text, item_id) AS text, CASE WHEN item_id % 20 % 2 = 0 THEN 'hint ' || min(item_id) END AS hints FROM benchmark GROUP BY item_id % 20)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("item_id") % 20
    return table(spark, d, "benchmark").groupBy(q.alias("query")).agg(F.min_by("text", "item_id").alias("text"), F.min("item_id").alias("i")).select("query", "text", F.when(F.col("query") % 2 == 0, F.concat(F.lit("hint "), F.col("i").cast("string"))).alias("hints"))


@query(f"""WITH {_BLOCKS}, {_ASKED}, s AS (SELECT query, sum(length(block) // 4)::BIGINT AS context_tokens FROM by_ GROUP BY 1), a AS (SELECT query, length(text) // 4 AS problem_tokens, length(coalesce(hints, '')) // 4 AS hints_tokens, coalesce(context_tokens, 0) AS context_tokens FROM p LEFT JOIN s USING (query))
SELECT *, context_tokens + problem_tokens + hints_tokens + 300 AS total, context_tokens + problem_tokens + hints_tokens + 300 <= 7000 AS within_budget FROM a""")
def prompt_tokens(spark: SparkSession, d: str) -> DataFrame:
    return context.token_estimate(context.prompt_blocks(_unlike(spark, d)), _asked(spark, d), 300, 7000)


@query(f"""WITH {_BLOCKS}, {_ASKED}, s AS (SELECT query, string_agg(block, chr(10) || chr(10) ORDER BY place) AS context FROM by_ GROUP BY 1)
SELECT query, md5(concat_ws(chr(10) || chr(10), '# Problem' || chr(10) || text, '# Hints' || chr(10) || hints, '# Context' || chr(10) || context)) AS prompt_md5 FROM p LEFT JOIN s USING (query)""")
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    return context.prompts(_asked(spark, d), context.prompt_blocks(_unlike(spark, d))).select("query", F.md5("prompt").alias("prompt_md5"))


@query(f"WITH {_CHUNKS} SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM t WHERE context_type = 'function_definition' QUALIFY rank <= 5")
def context_by_type(spark: SparkSession, d: str) -> DataFrame:
    return context.most_relevant(context.by_type(_chunks(spark, d), "function_definition"), 5).select("query", "doc", "score", "rank")


@query(r"""WITH f AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo, regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1) AS path FROM pages), k AS (SELECT DISTINCT repo, 0 AS kind, path AS item FROM f WHERE path <> '' UNION SELECT DISTINCT repo, 1, regexp_extract(path, '^(.*)/[^/]*$', 1) FROM f WHERE regexp_extract(path, '^(.*)/[^/]*$', 1) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY repo, kind ORDER BY item) AS n FROM k QUALIFY n <= 10 AND (kind = 0 OR n <= 5)), a AS (SELECT repo, string_agg(item, ', ' ORDER BY n) FILTER (kind = 0) AS f, string_agg(item, ', ' ORDER BY n) FILTER (kind = 1) AS d FROM n GROUP BY 1)
SELECT repo, '### Repository Structure' || chr(10) || concat_ws(chr(10), 'Key files: ' || f, 'Directories: ' || d) AS structure FROM a""")
def repo_structure(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("repo"), F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^?#]*)", 1).alias("path"))
    return context.structure_text(files)


@query("SELECT event_type, event_id, count(*) OVER w AS gathered, avg((props->>'$.k')::BIGINT) OVER w AS mean_so_far FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def gather_stats(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").withColumn("tokens", F.from_json("props", "k long")["k"])
    return context.gather_stats(runs, "event_type", ["ts", "event_id"], "tokens", F.date_trunc("hour", F.col("ts"))).select("event_type", "event_id", "gathered", "mean_so_far")


@query("SELECT doc_id, CASE WHEN m IN ('gpt-4o', 'gpt-4o-mini-x') THEN 'o200k_base' ELSE 'cl100k_base' END AS encoding FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini-x' WHEN 2 THEN 'gpt-5-x' ELSE 'other' END AS m FROM documents)")
def model_encoding(spark: SparkSession, d: str) -> DataFrame:
    m = F.element_at(F.array(*map(F.lit, ["gpt-4o", "gpt-4o-mini-x", "gpt-5-x", "other"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.encoding_of(m).alias("encoding"))


@query(r"""WITH r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Sure.' || chr(10) || '```diff' || chr(10) || '--- a/x' || chr(10) || '+++ b/x' || chr(10) || '```' WHEN 1 THEN 'no patch, confidence: 0.7' WHEN 2 THEN 'text' || chr(10) || '--- a/y' || chr(10) || '+++ b/y' || chr(10) || '@@' ELSE 'Confidence score: 1.0 ' || text END AS reply FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'diff --- a/x' || chr(10) || '+++ b/x' WHEN 2 THEN '--- a/y' || chr(10) || '+++ b/y' || chr(10) || '@@' END AS patch, CASE turn % 4 WHEN 1 THEN 0.7::DOUBLE WHEN 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM r""")
def reply_patches(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(F.lit("Sure.\n```diff\n--- a/x\n+++ b/x\n```"), F.lit("no patch, confidence: 0.7"), F.lit("text\n--- a/y\n+++ b/y\n@@"), F.concat(F.lit("Confidence score: 1.0 "), F.col("text")))
    r = table(spark, d, "conversations").select("conv_id", "turn", F.element_at(forms, (F.col("turn") % 4 + 1).cast("int")).alias("reply"))
    return r.select("conv_id", "turn", T.patch_of(F.col("reply")).alias("patch"), T.confidence_of(F.col("reply")).alias("confidence"))


@query(r"""SELECT page_id, regexp_extract(p, '([^/]*)$', 1) AS base, lower(regexp_extract(regexp_extract(p, '([^/]*)$', 1), '[^.](\.[^.]+)$', 1)) AS ext FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]+)', 1) || '.PY' AS p FROM pages)""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.regexp_extract("url", "^[a-z]+://([^?#]+)", 1), F.lit(".PY"))
    return table(spark, d, "pages").select("page_id", T.basename(p).alias("base"), T.extension(p).alias("ext"))


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 1000) / 800.0), 0)::BIGINT + 1)) * 800 AS start FROM documents WHERE length(text) > 0), c AS (SELECT *, substr(text, start + 1, 1000) AS content FROM w WHERE length(trim(substr(text, start + 1, 1000))) > 0)
SELECT doc_id, start, len(string_split(substr(text, 1, start), chr(10))) AS start_line, len(string_split(substr(text, 1, start + length(content)), chr(10))) AS end_line FROM c""")
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """Character windows with the lines that they begin and end in."""
    docs = table(spark, d, "documents")
    cut = chunking.char_chunks(docs, least=0).where(F.length(F.trim("content")) > 0)
    return chunking.with_lines(cut, docs).select("doc_id", "start", "start_line", "end_line")


@query(r"SELECT doc_id, len(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS n, md5(array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> ''), ' ')) AS tokens_md5 FROM documents")
def whitespace_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.whitespace_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def _paragraph_cuts(_: int, text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for part in text.split("\n\n"):
        out.append((at, at + len(part)))
        at += len(part) + 2
    return out


@query("SELECT doc_id, unnest(range(len(ps)))::INT AS chunk, md5(unnest(ps)) AS content_md5 FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents)")
def custom_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A chunker of one's own: paragraphs."""
    return chunking.custom_chunks(table(spark, d, "documents"), _paragraph_cuts, "doc_id", "text").select("doc_id", "chunk", F.md5("content").alias("content_md5"))


def _paragraphs(text: str) -> list[tuple[int, int]]:
    return _paragraph_cuts(0, text)


@query("SELECT doc_id, unnest(range(len(ps)))::INT AS chunk, md5(unnest(ps)) AS content_md5 FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents)")
def lateral_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same chunker as a table function, called in SQL text."""
    table_functions.register(spark, "paragraphs", table_functions.chunk_function(_paragraphs))
    return spark.sql("SELECT doc_id, chunk, md5(content) AS content_md5 FROM {docs} d, LATERAL paragraphs(d.text)", docs=table(spark, d, "documents"))


def _capital(line: str) -> bool:
    return line[:1] in tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), h AS (SELECT *, sum(CASE WHEN line = 1 OR regexp_matches(x, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS part FROM l),
g AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, part ORDER BY line) - 1) // 20 AS piece FROM h)
SELECT doc_id, min(line)::INT AS first, max(line)::INT AS last, md5(arg_min(x, line)) AS head_md5, sum(length(x))::INT AS n_chars FROM g GROUP BY doc_id, part, piece""")
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each document's lines, by a table function over its partitions."""
    table_functions.register(spark, "sections", table_functions.section_function(_capital, 20))
    ls = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content")).selectExpr("doc_id as key", "pos + 1 as line", "content")
    found = spark.sql("SELECT * FROM sections(TABLE(SELECT key, line, content FROM {ls}) PARTITION BY key ORDER BY line)", ls=ls)
    return found.select(F.col("key").alias("doc_id"), "first", "last", F.md5("head").alias("head_md5"), "n_chars")


@query("SELECT doc_id::VARCHAR AS instance_id, md5(text) AS model_patch, source AS model_name_or_path FROM documents")
def followed_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as predictions in files that a stream follows: it is started after each half, and once more."""
    spark.dataSource.register(tailing.Predictions)
    at = fresh(spark, "followed")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("instance_id"), F.md5("text").alias("model_patch"), F.col("source").alias("model_name_or_path"))
    for half in (0, 1, None):
        if half is not None:
            docs.where(F.pmod(F.xxhash64("instance_id"), F.lit(2)) == half).write.mode("append").json(f"{at}/in")
        stream = spark.readStream.format("predictions").load(f"{at}/in")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return adopt(spark.read.schema(tailing.SCHEMA).parquet(f"{at}/rows").select("instance_id", "model_patch", "model_name_or_path"), at)


#: Patches of conversations' turns: two files, one of them new, or one file without a head.
_PATCH = r"""CASE turn % 2 WHEN 0 THEN 'diff --git a/m' || conv_id || '.py b/m' || conv_id || '.py' || chr(10) || '--- a/m' || conv_id || '.py' || chr(10) || '+++ b/m' || conv_id || '.py' || chr(10) || '@@ -3,2 +' || turn + 3 || ',3 @@' || chr(10) || ' def keep():' || chr(10) || '-    old' || chr(10) || '+    new' || chr(10) || '+def made_' || turn || '():' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/new.py' || chr(10) || '@@ -0,0 +1 @@' || chr(10) || '+class Made:'
ELSE '--- a/x.py' || chr(10) || '+++ b/x.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+b' END"""


@query(f"""WITH p AS (SELECT conv_id, turn, {_PATCH} AS patch FROM conversations)
SELECT conv_id, turn, md5(patch) AS patch_md5, CASE turn % 2 WHEN 0 THEN 'm' || conv_id || '.py,new.py' ELSE 'x.py' END AS files, CASE turn % 2 WHEN 0 THEN 'made_' || turn || ',Made' ELSE '' END AS names, CASE turn % 2 WHEN 0 THEN (turn + 4) || ',' || (turn + 5) || ',1' ELSE '1' END AS lines,
CASE turn % 2 WHEN 0 THEN 'def keep():' || chr(10) || '    new' || chr(10) || 'def made_' || turn || '():' || chr(10) || 'class Made:' ELSE 'b' END AS code FROM p""")
def diff_parse(spark: SparkSession, d: str) -> DataFrame:
    """Files, names, lines and code of patches."""
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    two = F.concat(F.lit("diff --git a/m"), c, F.lit(".py b/m"), c, F.lit(".py\n--- a/m"), c, F.lit(".py\n+++ b/m"), c, F.lit(".py\n@@ -3,2 +"), (F.col("turn") + 3).cast("string"), F.lit(",3 @@\n def keep():\n-    old\n+    new\n+def made_"), t, F.lit("():\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+class Made:"))
    patch = F.when(F.col("turn") % 2 == 0, two).otherwise(F.lit("--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b"))
    p = table(spark, d, "conversations").select("conv_id", "turn", patch.alias("patch"))
    x = F.col("patch")
    return p.select("conv_id", "turn", F.md5(x).alias("patch_md5"), F.array_join(T.diff_files(x), ",").alias("files"), F.array_join(T.diff_names(x), ",").alias("names"), F.array_join(T.diff_lines(x).cast("array<string>"), ",").alias("lines"), T.diff_code(x).alias("code"))
