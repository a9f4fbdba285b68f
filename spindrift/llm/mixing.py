"""Mixing sources to target weights (DataFrame functions only).

Every source's documents are put in a permuted order and laid end to end as one stream of words;
the mix takes the first `target` words of the stream, which repeats after its end.  The stream is
cut into blocks of equal size.  A tree of multivariate-hypergeometric draws splits the exact block
quotas of all sources among the output shards, halving the shards at each level, and every shard
then owns disjoint blocks of each source's permuted block order, shuffled locally.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spindrift.llm.common import WORD, cut, reading

#: Different rows that one task orders at a time, about.
ROWS_A_BUCKET = 4_000
#: More sources than this are refused: their quotas are planned on the driver.
MAX_SOURCES = 1_000_000
#: Words that one task writes, about.
WORDS_A_TASK = 16_000_000
SPACED_WORD = r"[\x20\x09-\x0D]*+" + WORD
#: Sources in one literal of the plan.
PLAN_ROWS = 10_000


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share * all sizes dealt out by weight; a source stops at most * its size and the excess is dealt
    again by weight among the others until none is above."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        all_w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / all_w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / all_w
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        full = set(over)
        open_ = [i for i in open_ if i not in full]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """[shard, source] blocks: each node of the tree draws its left half's share of every source from the
    multivariate-hypergeometric law, so sums over shards are exact and shards differ by a block at most in all."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def go(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        left = rng.multivariate_hypergeometric(have, total * (mid - lo) // (hi - lo), method="marginals") if total else have * 0
        go(lo, mid, left)
        go(mid, hi, have - left)

    go(0, shards, np.array(quotas, dtype=np.int64))
    return out


def permutation(n: int, seed: int) -> tuple[int, int]:
    """(a, c) so that b -> (a * b + c) mod n permutes the blocks 0 .. n - 1."""
    rng = np.random.default_rng(seed)
    a = int(rng.integers(1, max(2, min(n, 2**31))))
    while math.gcd(a, n) != 1:
        a += 1
    return a, int(rng.integers(0, max(1, n)))


def plan(sources: list[tuple], weights: list[float], share: float, shards: int, block_words: int, seed: int) -> list[tuple]:
    """sources (source, size, rows) in their order -> source, size, rows, target, quota words, blocks, a, c, bounds.

    bounds[j] is the permuted block number at which shard j ends in this source.
    """
    out, want = [], targets([s[1] for s in sources], [weights[i % len(weights)] for i in range(len(sources))], share)
    words = [int(math.floor(t + 0.5)) for t in want]
    blocks = [-(-w // block_words) for w in words]
    ends = split_quotas(blocks, shards, seed).cumsum(axis=0)
    for i, (name, size, rows) in enumerate(sources):
        a, c = permutation(max(1, blocks[i]), seed + i)
        out.append((name, size, rows, float(want[i]), words[i], blocks[i], a, c, [int(x) for x in ends[:, i]]))
    return out


def row_keys(id_col: str, source_col: str, text_col: str) -> dict[str, Column]:
    """Two hashes that tell a document from all others by its id, source and text, nulls included."""
    cols = [F.col(c) for c in (id_col, source_col, text_col)]
    parts = [*cols, *(c.isNull() for c in cols)]
    return {"row_a": F.xxhash64(*parts), "row_b": F.xxhash64(F.lit(1), *parts)}


def mix(docs: DataFrame, weights: tuple = (3.0, 1.0, 2.0), share: float = 1.5, shards: int = 16, block_words: int = 65_536, seed: int = 11, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs -> id, source, size, source_size, target, copies, row_a, row_b; one row for each row of docs.

    copies: array of (copy, first_word, words, block, shard, place), what the mix takes of the document; a shard's
    rows are ordered by place, and words that no shard's quota holds aren't taken.  Documents are taken whole, except the one at
    which a source's target is met, which gives its first words.  size = number of words; null and empty texts have size 0 and are never
    taken.  Sources are ordered by code point, null last, and weigh `weights`, repeating.  The order in a source is by
    an MD5 of id and text, then by id, size and row_keys(), so reruns agree; rows that repeat an id are documents of their own, rows
    that repeat id, source and text are ordered as one and then dealt out again, so neither a null id nor a repeated row
    makes a task large; other columns are ignored, and an empty table gives none.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(str(seed)), F.coalesce(F.md5(text_col), F.lit("null"))))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), *(k.alias(c) for c, k in row_keys(id_col, source_col, text_col).items())))
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(((r["source"], r["size"], r["rows"]) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    planned = plan(found, list(weights), share, shards, block_words, seed)
    # As many buckets of the permuted order as tasks shall share a source; a bucket is a range of the key.
    buckets = {p[0]: 1 << max(0, min(24, math.ceil(math.log2(max(1, p[2]) / ROWS_A_BUCKET)))) for p in planned}
    schema = T.StructType.fromDDL("source string, source_size long, target double, quota long, blocks long, a long, c long, bounds array<long>, buckets long")
    side = _small(spark, [(p[0], p[1], p[3], p[4], p[5], p[6], p[7], p[8], buckets[p[0]]) for p in planned], schema)
    same = ["source", "key", "id", "size", "row_a", "row_b"]
    once = rows.groupBy(*same).agg(F.count("*").alias("again"))
    joined = once.join(side, once["source"].eqNullSafe(side["source"])).drop(side["source"])
    joined = joined.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * F.col("buckets"), 24))
    words = F.col("size") * F.col("again")
    w = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "row_a", "row_b")
    inner = F.sum(words).over(w.rowsBetween(Window.unboundedPreceding, 0)) - words
    sums = joined.groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    before = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
    at = joined.withColumn("inner", inner).join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    at = at.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("again") - 1)))
    at = at.withColumn("start", F.col("before") + F.col("inner") + F.col("nth") * F.col("size"))

    def piece(copy):
        first = F.col("start") + copy * F.col("source_size")
        words = F.least(F.col("size"), F.greatest(F.lit(0), F.col("quota") - first))
        block = F.floor(first / block_words).cast("long")
        return F.struct(copy.cast("int").alias("copy"), F.lit(0).cast("long").alias("first_word"), words.alias("words"), block.alias("block"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(1)), piece), lambda p: p["words"] > 0)
    placed = at.withColumn("copies", copies)
    # The block's place in the permuted order, and the shard whose quota of the tree reaches over it.
    shard = lambda p: F.size(F.filter("bounds", lambda e: e <= F.pmod(F.col("a") * p["block"] + F.col("c"), F.col("blocks"))))
    place = lambda p: F.xxhash64(F.lit(seed), F.col("id"), F.col("row_a"), F.col("nth"), p["copy"])
    full = F.transform("copies", lambda p: F.struct(p["copy"], p["first_word"], p["words"], p["block"], shard(p).alias("shard"), place(p).alias("place")))
    full = F.filter(full, lambda p: p["shard"] < shards)
    return reading(placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", full.alias("copies"), "row_a", "row_b"), rows)


def _small(spark, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """The plan's rows (one for each source) as JSON literals, PLAN_ROWS in each: a JVM-only plan."""
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    names = [f.name for f in schema]
    packs = [json.dumps([dict(zip(names, r, strict=True)) for r in rows[at : at + PLAN_ROWS]]) for at in range(0, len(rows), PLAN_ROWS)]
    table = F.array(*map(F.lit, packs))
    return spark.range(1).select(F.explode(table).alias("pack")).select(F.inline(F.from_json("pack", T.ArrayType(schema)))).select(*names)


def expand(docs: DataFrame, mixed: DataFrame, shards: int, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as it was taken, the last copy of a source cut to the words
    taken, dealt to its shard and in the shard's order.

    A shard is written by as many tasks as its words need (WORDS_A_TASK), each with a range of the shard's places, so that
    a task's rows don't grow with the corpus.

    Rows without an id or with a repeated one are found by their source and text as well; of rows that repeat all three
    one stands for each, so what was taken of them is there once.
    """
    mixed = cut(mixed)
    picked = mixed.where(F.size("copies") > 0).select(F.col("row_a").alias("_mix_a"), F.col("row_b").alias("_mix_b"), F.explode("copies").alias("_mix"), F.col("size").alias("_mix_size"))
    keys = row_keys(id_col, source_col, text_col)
    texts = docs.withColumns({"_mix_row_a": keys["row_a"], "_mix_row_b": keys["row_b"]})
    if mixed.groupBy("row_a", "row_b").count().where(F.col("count") > 1).take(1):
        texts = texts.dropDuplicates(["_mix_row_a", "_mix_row_b"])
    both = texts.join(picked, (F.col("_mix_row_a") == F.col("_mix_a")) & (F.col("_mix_row_b") == F.col("_mix_b")))
    # Words with the white space before each, so that a cut text is a prefix of the text.
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(SPACED_WORD), F.lit(0)), 1, F.col("_mix.words").cast("int"))
    text = F.when(F.col("_mix.words") < F.col("_mix_size"), F.array_join(words, "")).otherwise(F.col(text_col))
    taken = mixed.agg(F.sum(F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"]))).first()[0] or 0
    parts = max(1, -(-taken // (shards * WORDS_A_TASK)))
    # Equal ranges of the 64-bit place, in its order.
    part = F.shiftright((F.shiftright(F.col("_mix.place"), 32) + F.lit(2**31)) * F.lit(parts), 32)
    # A task for each range of each shard, by its number: hashes would put several into one.
    out = both.withColumn(text_col, text).withColumn("_mix_part", F.col("_mix.shard") * parts + part).repartitionById(shards * parts, F.col("_mix_part").cast("int"))
    return out.sortWithinPartitions("_mix.shard", "_mix.place").drop("_mix_row_a", "_mix_row_b", "_mix_a", "_mix_b", "_mix", "_mix_size", "_mix_part")
