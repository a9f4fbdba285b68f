"""MinHash near-duplicates with tensored banding.

Two small collections of m groups of r minima are computed; the table keys are the m * m pairs of
a group of the first with a group of the second.  So m * m tables of 2r minima each cost 2 * m * r
minima instead of 2 * m * m * r.  Candidates that share a table key are verified on full sets, word by word.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm.common import WORD, cut, raw, reading, release, slices
from spindrift.llm.components import connected_components
from spindrift.llm.shingles import MinHasher, Words, set_digest, shingle_hashes, shingle_sets
from spindrift.session import share_package

R = 3
#: A pair at exactly the threshold shares no table with this probability at most.
MISS = 2e-4
#: Of the pairs with a centre, those whose minima agree less than the threshold by more than this share are left to step 3.
SLACK = 0.2
#: 64-bit words of parities() of a set.
PARITY_WORDS = 16


def groups_for(percent: int) -> int:
    """m, so that at the threshold both collections have an equal group but for MISS."""
    hit, m = (percent / 100) ** R, 1
    while 1 - (1 - (1 - hit) ** m) ** 2 > MISS:
        m += 1
    return m


def row_key(id_col: str, text_col: str) -> dict[str, Column]:
    """id and two hashes of the text: what tells rows apart; rows that agree in all three are copies."""
    return {"id": F.col(id_col).cast("long"), "h1": F.xxhash64(F.col(text_col)), "h2": F.xxhash64(F.lit(1), F.col(text_col))}


def signatures(rows: DataFrame, m: int, width: int) -> DataFrame:
    """rows(id, h1, h2, text) -> id, h1, h2, n, digest, minima; n = size of the shingle set, digest and minima null if it is empty.

    Ids pass through Python as Arrow columns, so they stay what they are, nulls and large ones included.
    """
    share_package(rows.sparkSession)

    def run(batches):
        hasher = MinHasher(2 * m * R)
        none = np.zeros(0, np.int32)
        for b in slices(batches):
            sets = shingle_hashes(raw(b.column("text")), width)
            low = [hasher(s) if len(s) else none for s, _ in sets]
            full = np.array([len(s) > 0 for s, _ in sets])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in low]))).astype(np.int32)
            minima = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low)), mask=pa.array(~full))
            digest = pa.array([set_digest(*s) if len(s[0]) else None for s in sets], pa.binary())
            n = pa.array([len(s) for s, _ in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h1"), b.column("h2"), n, digest, minima], ["id", "h1", "h2", "n", "digest", "minima"])

    return rows.select("id", "h1", "h2", "text").mapInArrow(run, "id long, h1 long, h2 long, n long, digest binary, minima array<int>")


def _agreement(a: Column, b: Column) -> Column:
    """Minima that are equal."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def table_keys(reps: DataFrame, m: int) -> DataFrame:
    """reps(id, minima) -> id, key: the table keys of the texts that may share one with another.

    A pair needs an equal group in either collection.  So the 2m single groups are counted first and
    only those that occur twice are combined: most texts have none and make no table key at all.
    """
    group = lambda j: F.struct(j.alias("j"), F.xxhash64(j, F.slice("minima", j * R + 1, R)).alias("g"))
    singles = reps.select("id", F.inline(F.transform(F.sequence(F.lit(0), F.lit(2 * m - 1)), group)))
    twice = singles.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    held = singles.join(twice, "g").groupBy("id").agg(F.collect_list(F.struct("j", "g")).alias("gs"))
    first, second = F.filter("gs", lambda x: x["j"] < m), F.filter("gs", lambda x: x["j"] >= m)
    pairs = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["g"], y["g"]))))
    return held.where((F.size(first) > 0) & (F.size(second) > 0)).select("id", F.explode(pairs).alias("key"))


def verify(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """pairs(a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Hashes refuse a pair; one that they accept is confirmed on the words of its common shingles.
    """
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    share_package(pairs.sparkSession)

    def run(batches):
        for b in slices(batches):
            xs, ys = raw(b.column("text_a")), raw(b.column("text_b"))
            uniq = list(dict.fromkeys([*xs, *ys]))
            sets = dict(zip(uniq, shingle_sets(uniq, width), strict=True))
            words: dict[bytes | None, Words] = {}
            keep = []
            for x, y in zip(xs, ys, strict=True):
                p, q = sets[x], sets[y]
                same = lambda c, total: c > 0 and 100 * c >= percent * (total - c)
                ok = same(len(np.intersect1d(p, q, assume_unique=True)), len(p) + len(q))
                if ok:
                    words = {t: words.get(t) or Words(t, width) for t in (x, y)}  # neighbours often share a centre
                    ok = same(words[x].common(words[y]), len(words[x]) + len(words[y]))
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    """texts(id, text) -> id, h: a row for each shingle of each text."""
    share_package(texts.sparkSession)

    def run(batches):
        for b in slices(batches, 64):
            sets = shingle_sets(raw(b.column("text")), width)
            at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "h"])

    return texts.select("id", "text").mapInArrow(run, "id binary, h long")


def unshared(texts: DataFrame, width: int) -> DataFrame:
    """texts(id, text) -> id, u: how many of a text's shingles no other text has (texts without such have no row).

    Those can be in no intersection, so they bound every link of the text without a look at pairs.  The count is grouped
    by shingle and pre-aggregated, whatever a shingle's frequency.
    """
    once = shingle_rows(texts, width).groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
    return once.groupBy("id").agg(F.count("*").alias("u"))


def parities(rows: DataFrame) -> DataFrame:
    """rows(id, h) -> id, b0, b1, ..: for each of 64 * PARITY_WORDS classes of hashes whether the set has an odd number of that class.

    Each shingle that only one of two sets has turns one bit, so no more bits of two sets differ than that.
    """
    word, bit = F.pmod("h", F.lit(PARITY_WORDS)), F.pmod(F.shiftright("h", 8), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return rows.groupBy("id").agg(*(F.bit_xor(F.when(word == i, one).otherwise(F.lit(0).cast("long"))).alias(f"b{i}") for i in range(PARITY_WORDS)))


def prefix_pairs(texts: DataFrame, percent: int, width: int) -> DataFrame:
    """texts(id, text, c) -> a, b: pairs of texts of different classes c that could reach the threshold; none that does is left out.

    With all shingles ordered by how many of these texts have them, rarest first, two texts that are near enough share one of
    the first n - ceil(percent * n / 100) + 1 shingles of each (prefix filter), the smaller one of still fewer; and at the first that they
    share, what is left of either must still reach the threshold (positional filter).  Shingles of one text only are no keys.  So texts
    of one family that share their common part but not their rare shingles don't become pairs; nor do those of a family without rare
    ones, as parities() of their sets bound the difference from below within the join.  The join is by equality on the
    shingle; Spark may split the rows of a frequent one.
    """
    rows = cut(shingle_rows(texts, width))
    df = rows.groupBy("h").agg(F.count("*").alias("f"))
    w = Window.partitionBy("id").orderBy("f", "h")
    placed = rows.join(df, "h").withColumn("p", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("id")))
    p = F.lit(percent)
    placed = placed.where((F.col("f") > 1) & (F.col("p") <= F.col("n") - F.ceil(p * F.col("n") / 100) + 1))
    bits = [f"b{i}" for i in range(PARITY_WORDS)]
    placed = cut(placed.join(texts.select("id", "c"), "id").join(parities(rows), "id").select("h", "id", "c", "n", "p", *bits))
    # The smaller of two texts needs 2 * percent / (100 + percent) of its shingles in common, so its prefix is shorter.
    small = placed.where(F.col("p") <= F.col("n") - F.ceil(2 * p * F.col("n") / (100 + p)) + 1)
    x, y = placed.select("h", *(F.col(k).alias(f"{k}x") for k in ("id", "c", "n", "p", *bits))), small.select(F.col("h").alias("hy"), *(F.col(k).alias(f"{k}y") for k in ("id", "c", "n", "p", *bits)))
    order = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("idy") < F.col("idx")))
    room = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + 1
    fits = (100 + p) * room >= p * (F.col("nx") + F.col("ny"))
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{b}x").bitwiseXOR(F.col(f"{b}y"))) for b in bits))
    close = (100 + p) * apart <= (100 - p) * (F.col("nx") + F.col("ny"))
    found = cut(x.join(y, (F.col("h") == F.col("hy")) & order & (F.col("cx") != F.col("cy")) & fits & close).select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct())
    release(rows, placed)
    return found


class Linked:
    """What near_duplicates and keep_one share: sigs (a row for each row of docs) and named (digest, c, component_id)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int, width: int, exact: bool):
        m = groups_for(percent)
        rows = docs.select(*(c.alias(k) for k, c in row_key(id_col, text_col).items()), F.col(text_col).alias("text"))
        self.sigs = sigs = cut(signatures(rows, m, width))
        first = F.struct(F.col("id").isNull(), "id", "h1", "h2")
        # A node is a class of equal sets, by its digest; `low` is its smallest id, `pick` the row whose text stands for it.
        reps = cut(sigs.where("n > 0").groupBy(F.col("digest").alias("id")).agg(F.any_value("n").alias("n"), F.any_value("minima").alias("minima"), F.min(first).alias("pick"), F.min("id").alias("low")))
        links = self._links(rows, reps, m, percent, width, exact)
        comps = connected_components(reduce(DataFrame.unionByName, links).toDF("src", "dst"))
        named = cut(reps.select("id", "low").join(comps.toDF("id", "c"), "id", "left").select(F.col("id").alias("digest"), F.coalesce("c", "id").alias("c"), "low"))
        # A table of its own, so that Spark may split a large component's rows in the join.
        least = cut(named.groupBy("c").agg(F.min("low").alias("component_id")))
        self.named = cut(named.join(least, "c").select("digest", "c", "component_id"))
        release(reps, named, least, comps, *links)

    def _links(self, rows: DataFrame, reps: DataFrame, m: int, percent: int, width: int, exact: bool) -> list[DataFrame]:
        def text_of(wanted: DataFrame) -> DataFrame:
            """wanted(id) -> id, text."""
            k = reps.join(wanted, "id", "left_semi").select(F.col("id").alias("node"), F.col("pick.id").alias("k"), F.col("pick.h1").alias("k1"), F.col("pick.h2").alias("k2"))
            found = rows.join(k, F.col("id").eqNullSafe(F.col("k")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
            return found.select(F.col("node").alias("id"), "text").dropDuplicates(["id"])

        if exact:
            texts = cut(text_of(reps.select("id")).withColumn("c", F.col("id")))
            return [cut(verify(prefix_pairs(texts, percent, width), texts, percent, width))]
        all_keys = cut(table_keys(reps, m))
        met = all_keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        met = cut(all_keys.join(met, "key"))
        texts = cut(text_of(met.select("id").distinct()))
        # Of each text the size n of its set and the number s of shingles that it may share.
        sizes = reps.select("id", "n").join(unshared(texts, width), "id", "left").select("id", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("s"))
        keys = cut(met.join(sizes.where(100 * F.col("s") >= percent * F.col("n")), "id"))
        common = F.least("sa", "sb")
        can_link = 100 * common >= percent * (F.col("na") + F.col("nb") - common)
        # A key's centre is the text with fewest shingles of its own: of copies that were edited, the original.
        centres = keys.groupBy("key").agg(F.max_by(F.struct("id", "n", "s"), F.struct(F.col("s") - F.col("n"), "id")).alias("x")).select("key", F.col("x.id").alias("b"), F.col("x.n").alias("nb"), F.col("x.s").alias("sb"))
        members = keys.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
        stars = members.join(centres, (members["key"] == centres["key"]) & (F.col("a") != F.col("b")) & can_link).select("a", "b").distinct()
        sketch = lambda x: reps.select(F.col("id").alias(x), F.col("minima").alias(f"m_{x}"))
        near = stars.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", _agreement(F.col("m_a"), F.col("m_b")).alias("same"))
        stars = cut(near.where(F.col("same") >= (percent / 100 - SLACK) * 2 * m * R))
        # 1. Each text and its likeliest centre.
        best = stars.groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b"))
        links = [cut(verify(best, texts, percent, width))]
        # 2. Each text and its other centres, unless already in their component.
        c1 = c = connected_components(links[0].toDF("src", "dst"))
        other = stars.select("a", "b").join(best, ["a", "b"], "left_anti").join(c.toDF("a", "ca"), "a", "left").join(c.toDF("b", "cb"), "b", "left")
        links.append(cut(verify(other.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), texts, percent, width)))
        # 3. Keys that hold several components: their texts, by the rare shingles that they share.
        c = connected_components(links[0].unionByName(links[1]).toDF("src", "dst"))
        held = keys.join(c.toDF("id", "c"), "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"))
        several = held.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        open_ = cut(texts.join(held.join(several, "key").select("id", "c").distinct(), "id"))
        rest = prefix_pairs(open_, percent, width)
        tried = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links.append(cut(verify(rest.join(tried, ["a", "b"], "left_anti"), open_, percent, width)))
        release(all_keys, met, texts, keys, stars, open_, rest, c1, c)
        return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, exact: bool = False) -> DataFrame:
    """docs -> id, n_shingles, component_id, kept; one row for each row of docs.

    component_id is the smallest id reachable over links of texts whose shingle sets have
    100 * intersection >= percent * union.  Texts with equal sets form one class first; links are
    searched between classes.  Every key's texts are compared with one centre; then, for keys that still hold several
    components, their texts are joined by the rare shingles that they share (prefix_pairs), which leaves no pair of
    different components uncompared that could be linked.  So a large group of near copies costs a few comparisons for each text.
    Two texts that share no table key are not compared: at exactly the threshold at most MISS of the pairs, less above
    it.  exact: compare by prefix_pairs() alone, without tables and without that loss, at a higher cost.

    Null or empty texts have no shingles, are linked with nothing and keep their own id.  Rows with a null id link others but
    get their component's smallest id, null if no row of it has one, and kept = false.  Rows that repeat an id
    are told apart by their texts; other columns are ignored.  An empty table gives an empty result.
    """
    found = Linked(docs, id_col, text_col, percent, width, exact)
    out = found.sigs.join(found.named, "digest", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return reading(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))), found.sigs, found.named)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, exact: bool = False) -> DataFrame:
    """The rows of docs, with all columns, that stay: of each component of near_duplicates() the row with the smallest id.

    Exactly one row of a component stays, also if ids are null (last) or repeat (then the smaller hash of the text, and any one of
    rows that agree in id and text); texts without shingles all stay.  An empty table gives an empty result.
    """
    found = Linked(docs, id_col, text_col, percent, width, exact)
    key = ["id", "h1", "h2"]
    in_class = found.sigs.where("n > 0").join(found.named, "digest").groupBy("c", *key).agg(F.count("*").alias("copies"))
    in_class = cut(in_class)
    best = cut(in_class.groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), *key)).alias("best")))
    ranked = cut(in_class.join(best, "c").select(*key, "copies", *(F.col(f"best.{k}").eqNullSafe(F.col(k)).alias(f"is_{k}") for k in key)).select(*key, "copies", (F.col("is_id") & F.col("is_h1") & F.col("is_h2")).alias("stays")))
    release(in_class, best)
    gone = ranked.where("not stays or copies > 1").select(*(F.col(k).alias(f"_gone_{k}") for k in key))
    rows = docs.select(F.struct("*").alias("_row"), *(c.alias(f"_row_{k}") for k, c in row_key(id_col, text_col).items()))
    same = F.col("_row_id").eqNullSafe(F.col("_gone_id")) & (F.col("_row_h1") == F.col("_gone_h1")) & (F.col("_row_h2") == F.col("_gone_h2"))
    has_words = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    out = rows.join(gone, same, "left_anti").select("_row.*")
    again = ranked.where("stays and copies > 1").select(*(F.col(k).alias(f"_gone_{k}") for k in key))
    if again.take(1):
        one = docs.where(has_words).select(F.struct("*").alias("_row"), *(c.alias(f"_row_{k}") for k, c in row_key(id_col, text_col).items())).join(again, same, "left_semi")
        out = out.unionByName(one.groupBy("_row_id", "_row_h1", "_row_h2").agg(F.any_value("_row").alias("_row")).select("_row.*"))
    return reading(out, found.sigs, found.named, ranked)
