"""A corpus from documents: quality, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import minhash_dedup, mixing, packing, quality
from spindrift.llm.common import Scope, cut, reading, release, table

#: No SQL: the first stage is a trained model, the last one a tokenizer and a heuristic.
ORACLE_SQL = None
SHARDS = 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null and empty texts are judged like others; no rows give none."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).where("_q_keep").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id; texts without words all stay.

    Of rows that repeat an id or have none each text counts for itself, and exactly one row of a group stays.
    """
    return minhash_dedup.keep_one(docs).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights; a document taken twice is there twice, one cut at a source's target is cut; documents
    without words are never taken."""
    out = mixing.expand(docs, mixing.mix(docs, shards=SHARDS), SHARDS)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, a row for each piece; null texts are empty, rows that repeat are packed each."""
    return packing.pack(docs, with_ids=True)


STAGES = [("quality", quality_stage), ("near duplicates", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with Scope() as scope:
            new = scope.keep(cut(stage(spark, docs, sf_dir)))
        release(docs)
        docs = new
    return reading(STAGES[-1][1](spark, docs, sf_dir), docs)
