"""Tests of ranks and variances: mid-ranks by range partitions, tails of distributions as built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.tables import cut, reading

#: Lanczos' coefficients of the gamma function (g = 7), and the rational approximation of the normal distribution's tail.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
_ABOVE = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
_BELOW = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def normal_cdf(z: Column) -> Column:
    """P(Z <= z), to 14 places."""
    x = F.abs(z)
    horner = lambda cs: reduce(lambda s, c: s * x + c, cs[1:], F.lit(cs[0]))
    far = reduce(lambda s, n: x + F.lit(float(n)) / s, (4, 3, 2, 1), x + 0.65)
    tail = F.when(x < 7.07106781186547, F.exp(-x * x / 2) * horner(_ABOVE) / horner(_BELOW)).otherwise(F.exp(-x * x / 2) / far / math.sqrt(2 * math.pi))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def log_gamma(x: Column) -> Column:
    """Of x of a half or more."""
    t = x + 6.5
    series = reduce(lambda s, ic: s + F.lit(ic[1]) / (x - 1 + ic[0]), enumerate(_LANCZOS[1:], 1), F.lit(_LANCZOS[0]))
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(t) - t + F.log(series)


def beta_share(x: Column, a: Column, b: Column, steps: int = 300) -> Column:
    """The regularized incomplete beta function, by its continued fraction on the side where that converges fast."""
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b), F.when(flip, 1 - x).otherwise(x)
    keep = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    pair = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    d0 = 1 / keep(1 - (p + q) * y / (p + 1))

    def half(s: Column, n: Column) -> Column:
        d, c = 1 / keep(1 + n * s["d"]), keep(1 + n / s["c"])
        return pair(c, d, s["h"] * c * d)

    def step(s: Column, m: Column) -> Column:
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        return half(half(s, even), odd)

    ms = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda m: m.cast("double"))
    h = F.aggregate(ms, pair(F.lit(1.0), d0, d0), step)["h"]
    front = F.exp(p * F.log(y) + q * F.log(1 - y) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p
    part = F.when(y <= 0, 0.0).otherwise(front * h)
    return F.when(flip, 1 - part).otherwise(part)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) with d1 and d2 degrees of freedom."""
    return F.when(f <= 0, 1.0).otherwise(beta_share(d2 / (d2 + d1 * f), d2.cast("double") / 2, d1.cast("double") / 2))


def t_tails(t: Column, df: Column) -> Column:
    """P(|T| > |t|)."""
    return f_tail(t * t, F.lit(1), df)


def _simpson(f: Callable[[Column], Column], low: Column, high: Column, steps: int) -> Column:
    h = (high - low) / steps
    weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda s, i: s + weight(i) * f(low + h * i)) * h / 3


def studentized_range_tail(q: Column, groups: Column, df: Column, steps: int = 80) -> Column:
    """P(Q > q): the range of `groups` normal values over an independent estimate of their deviation with df degrees of freedom."""
    v, k = df.cast("double"), groups.cast("double")

    def of_range(w: Column) -> Column:
        one = lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * F.pow(F.greatest(normal_cdf(z) - normal_cdf(z - w), F.lit(0.0)), k - 1)
        return k * _simpson(one, F.lit(-8.0), F.lit(8.0), steps)

    def at(s: Column) -> Column:
        density = F.exp(F.log(F.lit(2.0)) + v / 2 * F.log(v / 2) - log_gamma(F.greatest(v / 2, F.lit(0.5))) + (v - 1) * F.log(F.greatest(s, F.lit(1e-300))) - v * s * s / 2)
        return density * of_range(q * s)

    spread = 8 / F.sqrt(2 * v)
    whole = _simpson(at, F.greatest(1 - spread, F.lit(0.0)), 1 + spread, steps)
    return F.greatest(F.least(1 - whole, F.lit(1.0)), F.lit(0.0))


# Ranks


def _same(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """left joined with right on equal cols, nulls among them; the columns of right but cols are added."""
    marked = right.select(*(F.col(c).alias(f"_r_{c}") for c in cols), *(c for c in right.columns if c not in cols))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols))
    return left.join(marked, on).drop(*(f"_r_{c}" for c in cols))


def midranks(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """counts(by..., value, n, ...): each value of a group once, with how often it occurs -> + rank, the mean place of its occurrences.

    Values are dealt by range, a partition sums its own counts, and what is before it comes from the partitions' totals, of which
    there is a row for each: no group is sorted by one task, and a value with a third of all rows is one row.
    """
    ranged = cut(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    key = [*by, "_part"]
    totals = ranged.groupBy(*key).agg(F.sum(n).alias("_t"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*key, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    out = _same(own, before, key).withColumn("rank", F.col("_before") + F.col("_own") + (F.col(n) + 1) / 2)
    return reading(out.drop("_part", "_before", "_own"), ranged)


def _finite(*cols: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols))


def wilcoxon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs(by..., x, y) -> by, n, w_plus, w_minus, z, p: signed ranks of x - y, normal approximation corrected for ties.

    Pairs without a difference, and those with a null or NaN, don't count; a group without others has n 0 and null z and p.
    """
    d = pairs.select(*by, F.when(_finite("x", "y"), (F.col("x") - F.col("y")).cast("double")).alias("_d"))
    moved = d.where(F.col("_d") != 0)
    counts = moved.groupBy(*by, F.abs("_d").alias("_a")).agg(F.count("*").alias("n"), F.count(F.when(F.col("_d") > 0, 1)).alias("_up"))
    ranked = midranks(counts, by, "_a")
    g = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("_up") * F.col("rank")).alias("w_plus"), F.sum((F.col("n") - F.col("_up")) * F.col("rank")).alias("w_minus"), F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("_ties"))
    every = d.select(*by).distinct().withColumn("_k", F.lit(1))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var))
    marked = g.select(*(F.col(c).alias(f"_r_{c}") for c in by), "n", "w_plus", "w_minus", z.alias("z"))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by))
    out = every.join(marked, on, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return reading(out.select(*by, zero("n").alias("n"), zero("w_plus").cast("double").alias("w_plus"), zero("w_minus").cast("double").alias("w_minus"), F.round("z", 6).alias("z"), F.round(2 * normal_cdf(-F.abs("z")), 6).alias("p")), ranked)


def spearman(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs(by..., x, y) -> by, n, rho, t, p: the correlation of mid-ranks; null below three pairs or without spread, t and p also at rho of 1."""
    counts = cut(pairs.where(_finite("x", "y")).groupBy(*by, "x", "y").agg(F.count("*").alias("_c")))
    one = lambda c: midranks(counts.groupBy(*by, c).agg(F.sum("_c").alias("n")), by, c).drop("n")
    rx, ry = one("x").withColumnRenamed("rank", "_x"), one("y").withColumnRenamed("rank", "_y")
    rows = _same(_same(counts, rx, [*by, "x"]), ry, [*by, "y"])
    means = counts.groupBy(*by).agg((F.sum("_c") / 2 + 0.5).alias("_m"))
    dx, dy, c = F.col("_x") - F.col("_m"), F.col("_y") - F.col("_m"), F.col("_c")
    g = _same(rows, means, by).groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(c * dx * dy).alias("_xy"), F.sum(c * dx * dx).alias("_xx"), F.sum(c * dy * dy).alias("_yy"))
    rho = F.when((F.col("n") > 2) & (F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy")))
    out = g.withColumn("_rho", rho).withColumn("_t", F.when(F.abs("_rho") < 1 - 1e-12, F.col("_rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("_rho") * F.col("_rho")))))
    return reading(out.select(*by, "n", F.round("_rho", 6).alias("rho"), F.round("_t", 6).alias("t"), F.round(t_tails(F.col("_t"), F.col("n") - 2), 6).alias("p")), counts, rx, ry)


# Variances


def _groups(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return rows.where(_finite(value)).groupBy(*by, F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.avg(v).alias("_mean"), F.var_pop(v).alias("_var"))


def anova(rows: DataFrame, by: list[str], group: str = "group", value: str = "value") -> DataFrame:
    """by, groups, n, f, p: one-way analysis of variance; null f and p below two groups, without a degree of freedom or spread inside the groups.

    A null group is one; null and NaN values don't count.
    """
    g = _groups(rows, by, group, value)
    total = g.groupBy(*by).agg(F.count("*").alias("groups"), F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("_grand"), F.sum(F.col("_n") * F.col("_var")).alias("_within"))
    off = F.col("_mean") - F.col("_grand")
    between = (_same(g, total, by) if by else g.crossJoin(total)).groupBy(*by, "groups", "n", "_within").agg(F.sum(F.col("_n") * off * off).alias("_between"))
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    out = between.withColumn("_f", F.when((d1 > 0) & (d2 > 0) & (F.col("_within") > 0), F.col("_between") / d1 / (F.col("_within") / d2)))
    return out.select(*by, "groups", "n", F.round("_f", 6).alias("f"), F.round(f_tail(F.col("_f"), d1, d2), 6).alias("p"))


def tukey(rows: DataFrame, by: list[str], group: str = "group", value: str = "value") -> DataFrame:
    """by, a, b, difference, q, p of each two groups (methods, few): the honest significant difference, for unequal sizes too."""
    g = _groups(rows, by, group, value)
    total = g.groupBy(*by).agg(F.count("*").alias("_k"), (F.sum("_n") - F.count("*")).alias("_df"), F.sum(F.col("_n") * F.col("_var")).alias("_within"))
    both = (_same(g, total, by) if by else g.crossJoin(total)).withColumn("_ms", F.when((F.col("_df") > 0) & (F.col("_within") > 0), F.col("_within") / F.col("_df")))
    right = g.select(*by, F.col("_g").alias("_g2"), F.col("_n").alias("_n2"), F.col("_mean").alias("_mean2"))
    pairs = (_same(both, right, by) if by else both.crossJoin(right)).where(F.col("_g") < F.col("_g2"))
    gap = F.col("_mean") - F.col("_mean2")
    q = F.abs(gap) / F.sqrt(F.col("_ms") / 2 * (1 / F.col("_n") + 1 / F.col("_n2")))
    out = pairs.withColumn("_q", q)
    return out.select(*by, F.col("_g").alias("a"), F.col("_g2").alias("b"), F.round(gap, 6).alias("difference"), F.round("_q", 6).alias("q"), F.round(F.when(F.col("_q").isNotNull(), studentized_range_tail(F.col("_q"), F.col("_k"), F.col("_df"))), 6).alias("p"))
