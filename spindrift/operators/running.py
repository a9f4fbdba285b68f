"""Running sums of groups that are larger than a task should hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_sums(rows: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """rows + the sums up to each row, in `order` within `by`.

    bucket: a value that doesn't fall along the order, such as the hour of a time or the first digits of a hash.  A window
    then holds one bucket of a group only; what is before it comes from the buckets' totals, of which a group has one row for
    each bucket.  Without it a group is one task's.  Nulls of `by` and `bucket` are values like others, those of `bucket` and of columns
    of `order` that are given by name come last; as in SQL, a sum passes over null summands and is null before the first other one.
    """
    value = {f"_v_{n}": c for n, c in sums.items()}
    order = [F.asc_nulls_last(c) if isinstance(c, str) else c for c in order]
    if bucket is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns(value).withColumns({n: F.sum(f"_v_{n}").over(w) for n in sums}).drop(*value)
    rows = rows.withColumn("_bucket", bucket).withColumns(value)
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(F.asc_nulls_last("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_bucket").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    before = totals.select(*(F.col(c).alias(f"_k_{c}") for c in [*by, "_bucket"]), *(F.sum(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in sums))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_bucket"]]
    out = rows.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in sums})
    on = same[0]
    for s in same[1:]:
        on = on & s
    out = out.join(before, on).withColumns({n: F.coalesce(F.col(n) + F.col(f"_b_{n}"), n, f"_b_{n}") for n in sums})
    return out.drop("_bucket", *value, *before.columns)
