"""Document fingerprints by invertible Bloom lookup sketches (DataFrame functions only).

A sketch has three tables of cells; each paragraph's digest is added to one cell of each: a count,
the xor of the digests and the xor of their check sums.  Two versions' sketches subtract cell by
cell, what they share cancels, and peeling cells that hold one digest recovers those that differ.
When peeling stalls, the sketch is made again, larger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm.common import cut, reading

#: (cells in each table, first bit of a digest that picks the cell in each table).  Digests are hashes, so their
#: bits serve as the tables' hash functions; the widths are powers of two.
SMALL = (8, (36, 39, 42))
#: Of a page's sketch, from the first try on; a page holds PAGE digests of both versions on average.
TRIES = ((4, (0, 2, 4)), (16, (9, 13, 17)), (32, (21, 26, 31)), (64, (0, 12, 24)))
PAGE = 5
#: The bit from which a digest picks its page.
PAGE_BIT = 45
_EMPTY_CELL = "struct(0 AS n, 0L AS k, 0 AS h)"
#: Rounds of peeling before a sketch counts as too small.
ROUNDS = 8
#: Rows of one stretch of neighbouring ids, about, and stretches at most; quantiles of the ids that bound them.
STRETCH, MOST_STRETCHES, QUANTILES = 500, 1_000_000, 1024


def _from_bit(key: Column, bit: int | Column) -> Column:
    """A digest's bits from `bit` on, as a number of 0 or more."""
    return F.call_function("shiftrightunsigned", key, F.lit(bit) if isinstance(bit, int) else bit)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def paragraphs(text: Column) -> Column:
    """Distinct digests (k) of the text's paragraphs, lines and the sentences within a line, with check sums (h)."""
    parts = F.filter(F.split(text, r"\s*\n\s*|(?<=[.!?])\s+"), lambda p: p != "")
    return F.transform(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))), lambda k: F.struct(k.alias("k"), F.hash(k).alias("h")))


def _placed(key: Column, check: Column, sign: Column, shape: tuple) -> Column:
    """A digest with its sign, check sum and cell in each table."""
    width, bits = shape
    at = lambda t: F.shiftrightunsigned(key, bits[t]).bitwiseAND(F.lit(width - 1)).cast("int").alias(f"c{t}")
    return F.struct(sign.alias("n"), key.alias("k"), check.alias("h"), at(0), at(1), at(2))


def _table(cells: Column, items: Column, sign: int, t: int) -> Column:
    """The cells of table t with items (of _placed) added or taken away."""

    def step(s: Column, y: Column) -> Column:
        return F.struct((s["n"] + sign * y["n"]).alias("n"), s["k"].bitwiseXOR(y["k"]).alias("k"), s["h"].bitwiseXOR(y["h"]).alias("h"))

    return F.transform(cells, lambda x, i: F.aggregate(F.filter(items, lambda y: y[f"c{t}"] == i), x, step))


def sketch(keys: Column, shape: tuple) -> Column:
    placed = F.transform(keys, lambda x: _placed(x["k"], x["h"], F.lit(1), shape))
    empty = F.array_repeat(F.expr(_EMPTY_CELL), shape[0])
    return let(placed, lambda items: F.concat(*(_table(empty, items, 1, t) for t in range(3))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells: Column, shape: tuple) -> Column:
    """struct(ok, plus, minus): the digests only the first, only the second version has; ok: all cells are empty.

    Each round takes every digest that is alone in some cell, once, out of its three cells.
    """
    width = shape[0]
    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("plus"), none.alias("minus"), F.lit(True).alias("more"))

    def step(s: Column, _: Column) -> Column:
        pure = F.array_distinct(F.filter(s["cells"], lambda x: F.when(F.abs(x["n"]) == 1, x["h"] == F.hash(x["k"])).otherwise(F.lit(False))))

        def take(pure: Column) -> Column:
            side = lambda n: F.transform(F.filter(pure, lambda y: y["n"] == n), lambda y: y["k"])
            placed = F.transform(pure, lambda x: _placed(x["k"], x["h"], x["n"], shape))
            left = lambda items: F.concat(*(_table(F.slice(s["cells"], t * width + 1, width), items, -1, t) for t in range(3)))
            new = let(placed, lambda items: F.struct(left(items).alias("cells"), F.concat(s["plus"], side(1)).alias("plus"), F.concat(s["minus"], side(-1)).alias("minus"), F.lit(True).alias("more")))
            return F.when(F.size(pure) == 0, F.struct(s["cells"].alias("cells"), s["plus"].alias("plus"), s["minus"].alias("minus"), F.lit(False).alias("more"))).otherwise(new)

        return F.when(s["more"], let(pure, take)).otherwise(s)

    def end(s: Column) -> Column:
        return F.struct(F.forall(s["cells"], lambda x: (x["n"] == 0) & (x["k"] == 0)).alias("ok"), s["plus"].alias("plus"), s["minus"].alias("minus"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, end)


def _page(a: Column, b: Column, tries: tuple = TRIES) -> Column:
    """peel() of two sets of digests, by sketches that grow until it succeeds; at last by the sets themselves."""
    if not tries:
        ka, kb = F.transform(a, lambda x: x["k"]), F.transform(b, lambda x: x["k"])
        return F.struct(F.lit(True).alias("ok"), F.array_except(ka, kb).alias("plus"), F.array_except(kb, ka).alias("minus"))
    found = peel(subtract(sketch(a, tries[0]), sketch(b, tries[0])), tries[0])
    return let(found, lambda r: F.when(r["ok"], r).otherwise(_page(a, b, tries[1:])))


def reconcile(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """struct(ok, plus, minus) of two versions' digests (columns of arrays) with their small sketches.

    First the small sketches are subtracted and peeled.  If that fails, the digests are dealt by hash to pages, as many
    as the two sizes need, and each page is sketched and peeled, larger again where it fails.
    """
    bits = F.greatest(F.lit(0.0), F.ceil(F.log2((F.size(a) + F.size(b) + 1) / PAGE))).cast("int")

    def part(keys: Column, low: int | Column, width: Column, i: Column) -> Column:
        return F.filter(keys, lambda x: F.call_function("mod", _from_bit(x["k"], low), F.call_function("shiftleft", F.lit(1).cast("long"), width)) == i)

    def split(a: Column, b: Column, low: int | Column, width: Column, then: Callable[[Column, Column], Column]) -> Column:
        """The digests dealt out by `width` bits from bit `low` on, and what `then` finds in each share."""
        shares = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), width) - 1)
        each = F.transform(shares, lambda i: let(F.struct(part(a, low, width, i).alias("a"), part(b, low, width, i).alias("b")), lambda s: then(s["a"], s["b"])))
        return let(each, lambda rs: F.struct(F.lit(True).alias("ok"), F.flatten(F.transform(rs, lambda r: r["plus"])).alias("plus"), F.flatten(F.transform(rs, lambda r: r["minus"])).alias("minus")))

    def all_pages(n: Column) -> Column:
        """In two steps of half the bits each, so that the work is no square of the digests."""
        half = F.shiftright(n, 1)
        return split(a, b, PAGE_BIT, half, lambda x, y: split(x, y, F.lit(PAGE_BIT) + half, n - half, _page))

    return let(peel(subtract(sketch_a, sketch_b), SMALL), lambda r: F.when(r["ok"], r).otherwise(let(bits, all_pages)))


def likeness(n_a: Column, n_b: Column, diff: Column) -> Column:
    """Shared paragraphs as a share of all, from the recovered differences; two empty texts: 1."""
    both, union = n_a - F.size(diff["plus"]), n_a + F.size(diff["minus"])
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def as_text(n: Column, cells: Column) -> Column:
    """A sketch as a string: the number of paragraphs, then count, digest and check sum of each cell."""
    cell = lambda x: F.concat(F.hex(x["n"]), F.lit("."), F.lower(F.hex(x["k"])), F.lit("."), F.lower(F.hex(x["h"].bitwiseAND(F.lit(0xFFFFFFFF)))))
    return F.concat(n.cast("string"), F.lit(":"), F.array_join(F.transform(cells, cell), ","))


def _derived(rows: DataFrame) -> DataFrame:
    """rows(..., text) + a, sa: the text's digests and small sketch."""
    return rows.withColumn("a", paragraphs(F.col("text"))).withColumn("sa", sketch(F.col("a"), SMALL))


def stretches(rows: DataFrame) -> DataFrame:
    """rows(id, text, md5) + stretch, an ordered number: ids of a smaller stretch are smaller, null ids last, and within one id
    of many rows the texts' MD5s are.

    Quantiles of the ids bound groups of stretches, which equal widths divide again; so an id far from all others leaves no more
    than a group's rows in one stretch.  Ids with more rows than a group should have, the null id among them, have stretches of
    their own, by MD5.
    """
    n, low, high = rows.agg(F.count("*"), F.min("id"), F.max("id")).first()
    most = max(4 * STRETCH, n // QUANTILES)
    heavy = {r["id"]: r["c"] for r in rows.groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") > most).collect()}  # QUANTILES at most
    low, high = (0, 0) if low is None else (low, high)
    cuts = max(1, min(QUANTILES, n // STRETCH))
    found = rows.agg(F.percentile_approx("id", [i / cuts for i in range(1, cuts)] or [0.5], 20 * cuts)).first()[0] or []
    alone = [j for i in heavy if i is not None for j in (i, min(i + 1, high))]
    bounds = sorted({low, *found, *alone})
    each = max(1, min(MOST_STRETCHES, n // STRETCH) // len(bounds))
    # The last bound that is not above the id, found in two steps.
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[at : at + wide] for at in range(0, len(bounds), wide)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    last = lambda xs: F.greatest(F.size(F.filter(xs, lambda b: b <= F.col("id"))), F.lit(1)) - 1
    rows = rows.withColumn("_group", last(longs(g[0] for g in groups)))
    place = F.col("_group") * wide + last(F.element_at(F.array(*map(longs, groups)), F.col("_group") + 1))
    rows = rows.withColumn("_place", F.when(F.col("id").isNull(), len(bounds)).otherwise(place))
    # Ids can span all of a long, so widths are decimals.
    ends = F.array(*(F.lit(str(b)).cast("decimal(20,0)") for b in [*bounds, high + 1]))
    from_, to = F.get(ends, F.col("_place")), F.get(ends, F.col("_place") + 1)
    sub = F.coalesce(F.floor((F.col("id").cast("decimal(20,0)") - from_) * each / (to - from_)).cast("long"), F.lit(0))
    hash_ = F.conv(F.substring("md5", 1, 5), 16, 10).cast("long")
    for i, c in heavy.items():
        bits = min(20, (c // STRETCH).bit_length())
        sub = F.when(F.col("id").eqNullSafe(F.lit(i).cast("long")), F.shiftright(hash_, 20 - bits)).otherwise(sub)
    return rows.withColumn("stretch", F.col("_place").cast("long") * (1 << 20) + sub).drop("_group", "_place")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs -> id, text, a, sa, copies, next_text, next_a, next_sa: with those of the next row by ascending id (null ids last,
    equal ids by the text's MD5); the last row's next is the first row.

    Rows that agree in id and text follow one another: they are one row until the end, with their number as copies, and a
    second one for those whose next is such a row itself.  Ids are cut into stretches, which one shuffle brings together; a window
    orders each, and its last row takes the first of the next stretch.  Only the list of stretches is ordered in one task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("md5", F.md5("text"))
    repeats = bool(rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").take(1))
    if repeats:
        rows = cut(rows.groupBy("id", "md5").agg(F.any_value("text").alias("text"), F.count("*").alias("again")))
    placed = stretches(rows)
    w = Window.partitionBy("stretch").orderBy(F.col("id").asc_nulls_last(), "md5")
    led = _derived(placed.repartition("stretch"))
    led = led.withColumn("last", F.lead(F.lit(1)).over(w).isNull()).withColumns({f"next_{c}": F.lead(c).over(w) for c in ("text", "a", "sa")})
    # One row for each stretch, some MOST_STRETCHES at most, of 100 bytes each; texts aren't shuffled for it.
    firsts = placed.groupBy("stretch").agg(F.min(F.struct(F.col("id").isNull(), "id", "md5")).alias("f")).select(F.col("stretch").alias("s"), F.col("f.id").alias("first_id"), F.col("f.md5").alias("first_md5"))
    first = placed.join(F.broadcast(firsts), (F.col("stretch") == F.col("s")) & F.col("id").eqNullSafe(F.col("first_id")) & (F.col("md5") == F.col("first_md5")))
    first = cut(_derived(first.select("stretch", "text")))
    ring = first.select("stretch", F.coalesce(F.lead("stretch").over(Window.orderBy("stretch")), F.min("stretch").over(Window.partitionBy())).alias("after"))
    heads = first.select(F.col("stretch").alias("after"), *(F.col(c).alias(f"head_{c}") for c in ("text", "a", "sa")))
    heads = ring.join(heads, "after").drop("after").withColumnRenamed("stretch", "s").withColumn("head", F.lit(True))
    out = led.join(heads, (F.col("stretch") == F.col("s")) & (F.col("last") == F.col("head")), "left")
    out = out.withColumn("itself", F.lit(False)).withColumn("copies", F.lit(1).cast("long"))
    if repeats:
        parts = F.array(F.struct(F.lit(False).alias("itself"), F.lit(1).cast("long").alias("copies")), F.struct(F.lit(True).alias("itself"), (F.col("again") - 1).alias("copies")))
        out = out.drop("itself", "copies").select("*", F.inline(F.filter(parts, lambda p: p["copies"] > 0)))
    pick = lambda c: F.when(F.col("itself"), F.col(c)).when(F.col("last"), F.col(f"head_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}")
    return reading(out.select("id", "text", "a", "sa", "copies", pick("text"), pick("a"), pick("sa")), rows, first)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, n_changed.

    The edited text has its last floor(n / 2) code points replaced by the first as many, or all, of the next text.  Null
    texts are empty; equal texts have equal fingerprints; a text without paragraphs is like another such (1.0) and unlike any
    other (0.0); a single row's next is itself; repeated rows each give a row; other columns are ignored; no rows give none.
    """
    found = with_next(docs, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = found.select("id", "copies", n.cast("long").alias("n_chars"), edited.alias("text"), F.col("a").alias("oa"), F.col("sa").alias("osa"), "next_a", "next_sa")
    rows = _derived(rows).select("id", "copies", "n_chars", F.sha2("text", 256).alias("edited_sha256"), F.col("a").alias("b"), F.col("sa").alias("sb"), F.col("oa").alias("a"), F.col("osa").alias("sa"), F.col("next_a").alias("c"), F.col("next_sa").alias("sc"))
    rows = rows.select("*", reconcile(F.col("a"), F.col("b"), F.col("sa"), F.col("sb")).alias("ab"), reconcile(F.col("a"), F.col("c"), F.col("sa"), F.col("sc")).alias("ac"))
    size = lambda x: F.size(x).cast("long")
    out = rows.select("copies", F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(size("a"), F.col("sa")).alias("fingerprint"), as_text(size("b"), F.col("sb")).alias("edited_fingerprint"), likeness(F.size("a"), F.size("b"), F.col("ab")).alias("near_edited"), likeness(F.size("a"), F.size("c"), F.col("ac")).alias("near_next"), size("a").alias("n_paragraphs"), (size("ab.plus") + size("ab.minus")).alias("n_changed"))
    return reading(out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies"), found)
