"""Connected components of an edge table, distributed (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import cut, reading, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(src, dst), any orderable type -> (node, component), component = the smallest node reachable.

    Each round rewires every edge towards the smallest neighbour of its ends (Kiveris et al., 2014);
    the rounds grow with the logarithm of the longest path.  Minima are pre-aggregated on the map
    side; a hub's edges meet its minimum in a join whose partitions Spark may split.  Each round
    is written to the shared folder.  Null ends and loops are ignored; no edge gives no row.
    """
    a, b = F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")
    now = cut(edges.where("src is not null and dst is not null and src <> dst").select(a, b).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        pairs = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(least, large["a"] == least["u"]).select(F.inline(pairs)).where("a <> b").distinct()
        new = cut(small)
        new_mark = _mark(new)
        release(now)
        now, same = new, new_mark == mark
        mark = new_mark
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    return reading(out, now)


def _mark(edges: DataFrame) -> tuple:
    """Rows and an order-free hash; two rounds with the same mark have the same edges."""
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.hash("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["x"], r["s"]
