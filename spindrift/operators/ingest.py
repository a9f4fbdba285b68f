"""Filters, validation and splits of instance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.text import diff_files, diff_names, test_list
from spindrift.operators.running import running_sums

def normalize(raw: DataFrame) -> DataFrame:
    """Source records to instances: renamed, test lists parsed, files and names of the patch derived, the rest in a map."""
    rest = [c for c in ("version", "issue_url", "pr_url", "created_at") if c in raw.columns]
    meta = F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string")))) if rest else F.expr("map()").cast("map<string,string>")
    hints = F.col("hints_text") if "hints_text" in raw.columns else F.lit(None).cast("string")
    return raw.select("instance_id", "repo", "base_commit", "problem_statement", hints.alias("hints"), "test_patch", "patch", test_list(F.col("FAIL_TO_PASS")).alias("failed_tests"), test_list(F.col("PASS_TO_PASS")).alias("passed_tests"), diff_files(F.col("patch")).alias("modified_files"), diff_names(F.col("patch")).alias("modified_methods"), meta.alias("metadata"))


def filter_repos(rows: DataFrame, repos: list[str], col: str = "repo") -> DataFrame:
    """Full name, name or owner in the list."""
    c = F.col(col)
    return rows.where(c.isin(repos) | F.element_at(F.split(c, "/"), -1).isin(repos) | F.element_at(F.split(c, "/"), 1).isin(repos))


def filter_ids(rows: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, col: str = "instance_id") -> DataFrame:
    """Semi and anti join by id; the lists are tables and can be large."""
    rows = rows.join(include.select(col).distinct(), col, "left_semi") if include is not None else rows
    return rows.join(exclude.select(col).distinct(), col, "left_anti") if exclude is not None else rows


def first_n(rows: DataFrame, n: int, order: str) -> DataFrame:
    return rows.orderBy(order).limit(n)


def select_instances(rows: DataFrame, repos: list[str] | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None, n: int | None = None, limit_first: bool = False, col: str = "instance_id", repo: str = "repo") -> DataFrame:
    """Filters and limit in one: the limit last, of rows by id; with limit_first it comes after the repositories and before the lists."""
    rows = filter_repos(rows, repos, repo) if repos else rows
    if limit_first and n is not None:
        rows = first_n(rows, n, col)
    rows = filter_ids(rows, include, exclude, col)
    return rows if limit_first or n is None else first_n(rows, n, col)


def join_patches(patches: DataFrame, instances: DataFrame, places: DataFrame, col: str = "instance_id") -> DataFrame:
    """Patches with their instance and its checkout's path, by id; patches without either stay, with nulls."""
    return patches.join(instances, col, "left").join(places, col, "left")


def repo_indexes(instances: DataFrame, indexes: DataFrame, repo: str = "repo") -> DataFrame:
    """Distinct repositories with their instances' number and their index, null if there is none yet."""
    return instances.groupBy(repo).agg(F.count("*").alias("instances")).join(indexes, repo, "left")


def invalid(rows: DataFrame, rules: dict[str, Column], id_col: str) -> DataFrame:
    """id, errors of the rows that break a rule (rules name what must hold; null counts as broken)."""
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(F.col(id_col), errors.alias("errors")).where(F.size("errors") > 0)


def instance_rules() -> dict[str, Column]:
    filled = {c: F.length(F.trim(F.col(c))) > 0 for c in ("instance_id", "repo", "base_commit", "problem_statement")}
    return {f"missing {c}": ok for c, ok in filled.items()} | {"bad instance_id": F.contains(F.col("instance_id"), F.lit("__")), "bad repo": F.contains(F.col("repo"), F.lit("/"))}


def stratified_split(rows: DataFrame, by: str, id_col: str, seed: int = 42, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """rows + split: within each stratum by the MD5 of id and seed, cut at floor(n * ratio) in double arithmetic.

    Places are counted within 256 ranges of the MD5, so that a large stratum is no task's own.
    """
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    placed = running_sums(rows.withColumn("_key", key), [by], ["_key", id_col], {"_place": F.lit(1)}, F.substring("_key", 1, 2))
    sizes = rows.groupBy(F.col(by).alias("_stratum")).agg(F.count("*").alias("_n"))
    a = F.floor(F.col("_n") * F.lit(train))
    b = a + F.floor(F.col("_n") * F.lit(valid))
    out = placed.join(sizes, F.col(by).eqNullSafe(F.col("_stratum")))
    return out.withColumn("split", F.when(F.col("_place") <= a, "train").when(F.col("_place") <= b, "valid").otherwise("test")).drop("_key", "_place", "_stratum", "_n")


def join_predictions(instances: DataFrame, predictions: DataFrame, col: str = "instance_id", order: str = "position") -> DataFrame:
    """Each instance with its prediction, null if none; the last of repeated ones counts."""
    w = Window.partitionBy(col).orderBy(F.desc(order))
    last = predictions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", order)
    return instances.join(last, col, "left")
