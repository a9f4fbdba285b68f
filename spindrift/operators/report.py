"""Method comparison: rows (method, instance, ...) to summaries, tests and grids."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.operators.running import running_sums

Z = 1.96


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def compare(results: DataFrame) -> DataFrame:
    """results(method, instance, resolved, applied, seconds, tokens) -> one row for each method; a mean skips nulls."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")) * 100, 2)
    return results.groupBy("method").agg(F.count("*").alias("total"), F.sum(F.col("resolved").cast("int")).alias("resolved"), rate("resolved").alias("resolution_rate"), rate("applied").alias("apply_rate"), F.round(F.avg("seconds"), 4).alias("avg_seconds"), F.sum("tokens").alias("tokens"))


def summary(results: DataFrame) -> DataFrame:
    """Methods, distinct instances, and the best method (the first by name of equals)."""
    rates = results.groupBy("method").agg(F.avg(F.col("resolved").cast("double")).alias("r"))
    best = rates.orderBy(F.desc("r"), "method").limit(1).select(F.col("method").alias("best_method"), F.round(F.col("r") * 100, 2).alias("best_rate"))
    return results.agg(F.count_distinct("method").alias("methods"), F.count_distinct("instance").alias("instances")).crossJoin(best)


def wilson(results: DataFrame) -> DataFrame:
    """Wilson's interval of each method's rate, percent."""
    g = results.groupBy("method").agg(F.count("*").alias("n"), F.avg(F.col("resolved").cast("double")).alias("p"))
    d = 1 + Z * Z / F.col("n")
    centre = (F.col("p") + Z * Z / (2 * F.col("n"))) / d
    margin = Z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + Z * Z / (4 * F.col("n") * F.col("n"))) / d
    pct = lambda c: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 100, 2)
    return g.select("method", "n", F.round(F.col("p") * 100, 2).alias("rate"), pct(centre - margin).alias("lower"), pct(centre + margin).alias("upper"))


def pairwise(results: DataFrame, p_values: bool = True) -> DataFrame:
    """Each pair of methods: rate difference, chi-square of the 2x2 table with Yates' correction (null if a margin is 0),
    p, stars, Cohen's h and its label."""
    from spindrift.operators.metrics import erfc

    g = results.groupBy("method").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("resolved").cast("double")).alias("k"))
    a, b = g.toDF("method_a", "na", "ka"), g.toDF("method_b", "nb", "kb")
    x = a.join(b, F.col("method_a") < F.col("method_b"))
    n, hit = F.col("na") + F.col("nb"), F.col("ka") + F.col("kb")
    gap = F.greatest(F.lit(0.0), F.abs(F.col("ka") * (F.col("nb") - F.col("kb")) - F.col("kb") * (F.col("na") - F.col("ka"))) - n / 2)
    margins = F.col("na") * F.col("nb") * hit * (n - hit)
    chi = F.when(margins > 0, n * gap * gap / margins)
    pa, pb = F.col("ka") / F.col("na"), F.col("kb") / F.col("nb")
    h = 2 * (F.asin(F.sqrt(pa)) - F.asin(F.sqrt(pb)))
    size = F.when(F.abs(h) < 0.2, "negligible").when(F.abs(h) < 0.5, "small").when(F.abs(h) < 0.8, "medium").otherwise("large")
    out = x.select("method_a", "method_b", F.round((pa - pb) * 100, 2).alias("difference"), F.round(chi, 6).alias("chi2"), F.round(h, 4).alias("cohen_h"), size.alias("effect"))
    if p_values:
        p = erfc(F.sqrt(F.col("chi2") / 2))
        out = out.withColumn("p", F.round(p, 6)).withColumn("stars", F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise(""))
    return out


def grid(rows: DataFrame, by: str, across: str, values: list, agg: Column, empty=None) -> DataFrame:
    """A pivot over given values (no pass to find them)."""
    out = rows.groupBy(by).pivot(across, values).agg(agg)
    return out.na.fill(empty) if empty is not None else out


def running(rows: DataFrame, by: str, order: list[str], resolved: str, bucket: Column | None = None) -> DataFrame:
    """Instances so far, resolved so far and the running rate of those that are not null; bucket: as running_sums() has it."""
    known = F.when(F.col(resolved).isNotNull(), 1)
    out = running_sums(rows, [by], order, {"seen": F.lit(1), "_known": known, "resolved_so_far": F.col(resolved).cast("int")}, bucket)
    return out.withColumn("running_rate", F.round(F.col("resolved_so_far") / F.col("_known") * 100, 6)).drop("_known")


def unpivot(rows: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return rows.select(*ids, *(F.col(m).cast("double") for m in metrics)).unpivot(ids, metrics, "metric", "value")


def detailed(results: DataFrame) -> DataFrame:
    """A row for each method and instance, arrays of tests as their sizes."""
    return results.select("method", "instance", "resolved", "applied", F.size("tests_passed").alias("tests_passed"), F.size("tests_failed").alias("tests_failed"), "codebleu", "seconds")


def evaluation_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """results(resolved, applied, codebleu, seconds, localization map) -> by, totals, rates and means; a localization key that a row
    lacks counts as 0 there."""
    by = by or []
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")) * 100, 6)
    base = results.groupBy(*by).agg(F.count("*").alias("total"), F.sum(F.col("resolved").cast("int")).alias("resolved"), rate("resolved").alias("resolution_rate"), rate("applied").alias("apply_rate"), F.round(F.avg("codebleu"), 6).alias("avg_codebleu"), F.round(F.avg("seconds"), 6).alias("avg_seconds"))
    sums = results.select(*by, F.explode("localization").alias("metric", "value")).groupBy(*by, "metric").agg(F.sum("value").alias("s"))
    if not by:
        joined = sums.crossJoin(base.select("total"))  # one row
        maps = joined.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.round(F.col("s") / F.col("total"), 6)))).alias("localization"))
        return base.crossJoin(maps)
    maps = sums.join(base.select(*by, "total"), by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.round(F.col("s") / F.col("total"), 6)))).alias("localization"))
    return base.join(maps, by, "left")


def series(results: DataFrame) -> DataFrame:
    """method, chart, label, value: what charts show, rates and seconds of methods and means of each localization key."""
    one = results.groupBy("method").agg(F.avg(F.col("resolved").cast("double")).alias("r"), F.avg("seconds").alias("s"))
    flat = one.select("method", F.inline(F.array(F.struct(F.lit("resolution").alias("chart"), F.lit("rate").alias("label"), F.round(F.col("r") * 100, 6).alias("value")), F.struct(F.lit("time").alias("chart"), F.lit("avg_seconds").alias("label"), F.round(F.col("s"), 6).alias("value")))))
    found = results.select("method", F.explode("localization").alias("label", "v")).groupBy("method", "label").agg(F.round(F.avg("v"), 6).alias("value"))
    return flat.unionByName(found.select("method", F.lit("localization").alias("chart"), "label", "value"))


def running_attempts(rows: DataFrame, by: str, order: list[str], attempts: str) -> DataFrame:
    """rows + mean and most attempts so far."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mean_so_far", F.round(F.avg(attempts).over(w), 6)).withColumn("most_so_far", F.max(attempts).over(w))


def errors(results: DataFrame, error: str = "error") -> DataFrame:
    """The rows that failed, with what they say and when."""
    return results.where(F.col(error).isNotNull()).select("method", "instance", F.col(error).alias("error"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


# Tests of documented methods: closed forms over grouped sums


def mcnemar(pairs: DataFrame) -> DataFrame:
    """pairs(method_a, method_b, a, b): outcomes of the same instance -> only_a, only_b, chi2 with continuity correction (null if both are 0)."""
    g = pairs.groupBy("method_a", "method_b").agg(F.sum((F.col("a") & ~F.col("b")).cast("int")).alias("only_a"), F.sum((~F.col("a") & F.col("b")).cast("int")).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    gap = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    return g.withColumn("chi2", F.when(n > 0, F.round(gap * gap / n, 6)))


def paired_t(pairs: DataFrame) -> DataFrame:
    """pairs(method_a, method_b, x, y): values of the same instance -> n, mean_difference, t (null below two pairs or without spread), cohen_d."""
    d = (F.col("x") - F.col("y")).cast("double")
    g = pairs.groupBy("method_a", "method_b").agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    ok = (F.col("n") > 1) & (F.col("s") > 0)
    return g.select("method_a", "method_b", "n", F.round("m", 6).alias("mean_difference"), F.when(ok, F.round(F.col("m") / (F.col("s") / F.sqrt("n")), 6)).alias("t"), F.when(ok, F.round(F.col("m") / F.col("s"), 6)).alias("cohen_d"))


def bonferroni(p: Column, tests: int | Column) -> Column:
    return F.least(F.lit(1.0), p * tests)


def signal_to_noise(relevant: Column, total: Column) -> Column:
    return safe_div(relevant, total)


def _rows(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: a report is for small tables; write the table instead")
    return rows


def markdown(title: str, tables: dict[str, DataFrame], most: int = 10_000) -> str:
    """Small result tables as Markdown, rendered on the driver; larger ones are refused, not cut."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in _rows(df, most)] + [""]
    return "\n".join(out)


def as_json(title: str, tables: dict[str, DataFrame], most: int = 10_000) -> str:
    """The same tables as one JSON object."""
    return json.dumps({"title": title, "tables": {n: [r.asDict(recursive=True) for r in _rows(df, most)] for n, df in tables.items()}}, default=str, ensure_ascii=False)
