"""BM25: an index is three tables, postings(doc, term, tf, dl), terms(term, df, idf) and stats(n_docs, avgdl)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from spindrift.functions.text import code_tokens
from spindrift.operators import blocks
from spindrift.tables import cut, reading, release

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class Index:
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        """Postings are kept in order of the term, so that a search reads the row groups of its terms only."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc").write.parquet(f"{path}/postings")
        self.terms.write.parquet(f"{path}/terms")
        self.stats.write.parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "stats")))

    def documents(self) -> int:
        return self.stats.first()["n_docs"]

    def lookup(self, doc) -> DataFrame:
        """A document's postings."""
        return self.postings.where(F.col("doc") == F.lit(doc))


def token_rows(docs: DataFrame, id_col: str, fields: dict[str, int], tokenizer=code_tokens) -> DataFrame:
    """doc, dl, term, n: a row for each token; n is its field's whole weight (a weight of 0 drops the field), dl the sum of all n."""
    held = {f: w for f, w in fields.items() if w > 0}
    rows = docs.select(F.col(id_col).alias("doc"), *(tokenizer(F.col(f)).alias(f"_{i}") for i, f in enumerate(held)))
    dl = sum((F.size(f"_{i}") * w for i, w in enumerate(held.values())), F.lit(0)).cast("long")

    def bag(i: int, weight: int) -> Column:
        return F.transform(f"_{i}", lambda t: F.struct(t.alias("term"), F.lit(weight).alias("n")))

    # dl comes before the rows are made: after that each of them would carry its document's whole array along.
    counted = rows.select("doc", dl.alias("dl"), *(f"_{i}" for i in range(len(held))))
    return counted.select("doc", "dl", F.inline(F.concat(*(bag(i, w) for i, w in enumerate(held.values())))))


def postings(rows: DataFrame) -> DataFrame:
    """doc, term, tf, dl: one shuffle on (doc, term), combined on the map side, where a document's tokens are together."""
    return rows.groupBy("doc", "dl", "term").agg(F.sum("n").cast("long").alias("tf")).select("doc", "term", "tf", "dl")


def term_stats(post: DataFrame, n_docs: int) -> DataFrame:
    """term, df, idf; a negative idf becomes EPSILON times the mean idf of all terms."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.select("term", "df", F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg((F.sum("raw") / F.count("*")).alias("mean"))
    return raw.crossJoin(mean).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def build(docs: DataFrame, id_col: str = "doc_id", fields: dict[str, int] | None = None, tokenizer=code_tokens) -> Index:
    """The index of docs, in the shared folder: every text is tokenized once, whatever reads the index."""
    post = cut(postings(token_rows(docs, id_col, fields or {"text": 1}, tokenizer)))
    n_docs = docs.count()
    terms = cut(term_stats(post, n_docs))
    stats = post.agg(F.lit(n_docs).cast("long").alias("n_docs"), (F.sum("tf") / F.lit(max(1, n_docs))).alias("avgdl"))
    return Index(post, terms, cut(stats))


#: Rows (query, term) that one pass over the postings answers; they are sent to every task.
PASS_ROWS = 2_000_000


def _pass(postings: DataFrame, wanted: DataFrame, avgdl: float, k: int, k1: float, b: float) -> DataFrame:
    """query, doc, score: the k best of each block of documents, among them the k best of all.

    The wanted terms' postings come together by document, whatever the number of queries; a task adds them up for all queries.
    """
    spark = postings.sparkSession
    rows = wanted.toArrow().combine_chunks()
    term, query = (rows[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("term", "query"))
    weights = blocks.Weights(term.indices.to_numpy(), query.indices.to_numpy(), rows["w"].to_numpy(), len(term.dictionary), len(query.dictionary))
    shared = spark.sparkContext.broadcast((weights, query.dictionary))
    ids = spark.createDataFrame(pa.table({"term": term.dictionary, "_t": pa.array(range(len(term.dictionary)), pa.int32())}))
    x = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    needed = postings.join(F.broadcast(ids), "term").select("doc", "_t", x.alias("x")).repartition("doc").sortWithinPartitions("doc")
    out = StructType([wanted.schema["query"], postings.schema["doc"], StructField("score", DoubleType())])
    most = blocks.SCORES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = shared.value
        held = blocks.Scores(weights, k, most)

        def found() -> Iterator[tuple]:
            for batch in batches:
                if batch.num_rows:
                    yield from held.add(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy())
            yield from held.flush()

        for doc, query, score in found():
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(query)), doc, pa.array(score)], ["query", "doc", "score"])

    return needed.mapInArrow(run, out)


def search_index(index: Index, queries: DataFrame, k: int = 10, query_id: str = "item_id", query_text: str = "text", k1: float = K1, b: float = B, tokenizer=code_tokens) -> DataFrame:
    """query, doc, score, rank: the k best of each query, positive scores only, ties by doc; a table in the shared folder.

    Postings are shuffled once by document, queries are sent to the tasks (PASS_ROWS at a time), and what is shuffled of pairs is
    each block's best: k rows of a query for blocks.SCORES scores.
    """
    asked = queries.select(F.col(query_id).alias("query"), F.explode(tokenizer(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    wanted = cut(index.terms.join(asked, "term").select("query", "term", (F.col("qtf") * F.col("idf")).alias("w")))
    parts = max(1, -(-wanted.count() // PASS_ROWS))
    avgdl = (index.stats.first() or {"avgdl": None})["avgdl"] or 1.0  # without a token there are no postings
    found = [_pass(index.postings, wanted.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == i) if parts > 1 else wanted, avgdl, k, k1, b) for i in range(parts)]
    hits = cut(top_k(reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", 6)).where("score > 0"), k))
    release(wanted)
    return reading(hits, hits)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", fields: dict[str, int] | None = None, query_id: str = "item_id", query_text: str = "text", k1: float = K1, b: float = B, tokenizer=code_tokens) -> DataFrame:
    """search_index() of an index made for it, which goes when the hits are written."""
    index = build(docs, id_col, fields, tokenizer)
    hits = search_index(index, queries, k, query_id, query_text, k1, b, tokenizer)
    release(index.postings, index.terms, index.stats)
    return hits


def retrieve(index: Index, queries: DataFrame, k: int = 10, min_score: float = 0.0, predicate: Column | None = None, key: DataFrame | None = None, fetch: int | None = None, **how) -> DataFrame:
    """Search, filter by score and predicate, one hit for each key (key: doc and the columns that make two documents one), limit, rank anew."""
    from spindrift.operators import fusion

    hits = fusion.threshold(search_index(index, queries, fetch or k, **how), min_score, predicate)
    if key is not None:
        cols = [c for c in key.columns if c != "doc"]
        hits = fusion.dedup(hits.join(key, "doc"), cols).drop(*cols)
    return top_k(hits.drop("rank"), k)


def top_k(scored: DataFrame, k: int, by: str = "query", score: str = "score", tie: str = "doc") -> DataFrame:
    """The k best of each `by` with ranks from 1; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def token_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    n = docs.select(F.size(code_tokens(F.col(text_col))).alias("n"))
    return n.agg(F.count("*").alias("chunks"), F.sum("n").alias("total_tokens"), F.round(F.avg("n"), 6).alias("avg_tokens"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"))
