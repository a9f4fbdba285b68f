"""Context assembly: rows by priority and score under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.text import CHARS_PER_TOKEN
from spindrift.operators.running import running_sums

#: Order of the context types, first ones first.
PRIORITY = ["error_context", "function_definition", "class_definition", "file_content", "related_code", "test_code", "documentation"]


#: The other order of context types, and the context type of each kind of chunk.
CORE_PRIORITY = ["error_context", "function_definition", "class_definition", "test_context", "repo_structure", "file_content", "import_dependency"]
TYPES = {"function": "function_definition", "method": "function_definition", "class": "class_definition", "import": "import_dependency", "test": "test_context", "error": "error_context", "module": "file_content"}


def context_type(chunk_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), chunk_type), F.lit("file_content"))


def priority(col: str = "context_type", order: list[str] | None = None):
    order = order or PRIORITY
    return F.coalesce(F.element_at(F.create_map(*(x for i, t in enumerate(order) for x in (F.lit(t), F.lit(i)))), F.col(col)), F.lit(len(order)))


def trim_to_budget(rows: DataFrame, budget: int, by: str = "query", text: str = "content", truncate_type: str = "file_content", least_left: int = 200, order: list[str] | None = None) -> DataFrame:
    """rows(by, doc, content, context_type, score) kept by (priority, -score, doc) while their running tokens fit.

    Token counts are not negative, so what fits is a prefix of the order: a running sum finds it.  The first
    row that doesn't fit is cut to the room, if it is of truncate_type and more than least_left tokens are left.
    """
    w = Window.partitionBy(by).orderBy(priority(order=order), F.desc("score"), "doc")
    n = F.floor(F.length(text) / CHARS_PER_TOKEN)
    run = rows.withColumn("tokens", n).withColumn("upto", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    left = budget - (F.col("upto") - F.col("tokens"))
    cut = (F.col("upto") > budget) & (left >= 0) & (F.col("context_type") == truncate_type) & (left > least_left)
    kept = run.withColumn("truncated", cut).where((F.col("upto") <= budget) | cut)
    out = F.when(F.col("truncated"), F.substring(F.col(text), F.lit(1), (left * CHARS_PER_TOKEN).cast("int"))).otherwise(F.col(text))
    return kept.withColumn(text, out).withColumn("tokens", F.floor(F.length(text) / CHARS_PER_TOKEN).cast("long")).drop("upto")


def core_trim(rows: DataFrame, budget: int = 8000, **cols: str) -> DataFrame:
    """trim_to_budget() in the other order, a row cut from 100 tokens left on."""
    return trim_to_budget(rows, budget, least_left=100, order=CORE_PRIORITY, **cols)


def block_head(path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("### "), path, F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")\n```\n"))


BLOCK_FOOT = "\n```"
CUT_MARK = "\n... [truncated]"


def prompt_blocks(rows: DataFrame, budget: int = 6500, by: str = "query", least: int = 50, order: list[str] | None = None) -> DataFrame:
    """rows(by, path, start_line, end_line, content, context_type, score) -> by, place, block, tokens, truncated: formatted blocks whose
    tokens fit, by (priority, -score, path, start_line).

    The first that doesn't fit ends the list; it is cut to the room if it is file content and `least` tokens are left for that.
    """
    w = Window.partitionBy(by).orderBy(priority(order=order), F.desc("score"), "path", "start_line")
    count = lambda c: F.floor(F.length(c) / CHARS_PER_TOKEN)
    head = block_head(F.col("path"), F.col("start_line"), F.col("end_line"))
    out = rows.withColumn("head", head).withColumn("block", F.concat("head", "content", F.lit(BLOCK_FOOT))).withColumn("tokens", count(F.col("block")))
    out = out.withColumn("upto", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    room = budget - (F.col("upto") - F.col("tokens"))
    free = room - count(F.col("head")) - count(F.lit(BLOCK_FOOT))
    over = F.col("upto") > budget
    cut = over & (room >= 0) & (F.col("context_type") == "file_content") & (free >= least)
    kept = out.withColumn("truncated", cut).withColumn("free", (free * CHARS_PER_TOKEN).cast("int")).where(~over | cut)
    short = F.concat("head", F.substring(F.col("content"), F.lit(1), F.col("free")), F.when(F.length("content") > F.col("free"), F.lit(CUT_MARK)).otherwise(F.lit("")), F.lit(BLOCK_FOOT))
    kept = kept.withColumn("block", F.when(F.col("truncated"), short).otherwise(F.col("block")))
    return kept.select(by, "place", "block", count(F.col("block")).cast("long").alias("tokens"), "truncated")


def by_type(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("context_type") == kind)


def most_relevant(rows: DataFrame, k: int, by: str = "query") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)


def structure_text(files: DataFrame, by: str = "repo", path: str = "path", room: int | None = None) -> DataFrame:
    """by, structure: the first ten paths and five folders, each in order; null if it has more than `room` tokens."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    kinds = files.select(by, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col(path).alias("item")), F.struct(F.lit(1).alias("kind"), folder.alias("item")))).alias("x")).select(by, "x.*").where("item <> ''").distinct()
    first = kinds.withColumn("n", F.row_number().over(Window.partitionBy(by, "kind").orderBy("item"))).where((F.col("n") <= 10) & ((F.col("kind") == 0) | (F.col("n") <= 5)))
    named = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("n", "item")))), lambda x: x["item"]), ", ")
    out = first.groupBy(by).agg(named(0).alias("f"), named(1).alias("d"))
    text = F.concat(F.lit("### Repository Structure\n"), F.concat_ws("\n", F.when(F.col("f") != "", F.concat(F.lit("Key files: "), F.col("f"))), F.when(F.col("d") != "", F.concat(F.lit("Directories: "), F.col("d")))))
    fits = F.lit(True) if room is None else F.floor(F.length("structure") / CHARS_PER_TOKEN) <= room
    return out.select(by, text.alias("structure")).withColumn("structure", F.when(fits, F.col("structure")))


def token_estimate(blocks: DataFrame, problems: DataFrame, overhead: int = 0, budget: int = 8000, by: str = "query") -> DataFrame:
    """blocks(by, block), problems(by, text, hints) -> by, context_tokens, problem_tokens, hints_tokens, total, within_budget."""
    count = lambda c: F.floor(F.length(F.coalesce(c, F.lit(""))) / CHARS_PER_TOKEN).cast("long")
    context = blocks.groupBy(by).agg(F.sum(count(F.col("block"))).alias("context_tokens"))
    out = problems.select(by, count(F.col("text")).alias("problem_tokens"), count(F.col("hints")).alias("hints_tokens")).join(context, by, "left").withColumn("context_tokens", F.coalesce("context_tokens", F.lit(0).cast("long")))
    out = out.withColumn("total", F.col("context_tokens") + F.col("problem_tokens") + F.col("hints_tokens") + overhead)
    return out.withColumn("within_budget", F.col("total") <= budget)


def prompts(problems: DataFrame, blocks: DataFrame, by: str = "query", feedback: str | None = None) -> DataFrame:
    """problems(by, text, hints, ...), blocks(by, place, block) -> by, prompt: problem, hints, context, and the column feedback of a failed try.

    Sections without content are left out.
    """
    w = F.transform(F.sort_array(F.collect_list(F.struct("place", "block"))), lambda x: x["block"])
    context = blocks.groupBy(by).agg(F.array_join(w, "\n\n").alias("context"))
    section = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"# {title}\n"), c))
    parts = [section("Problem", F.col("text")), section("Hints", F.col("hints")), section("Context", F.col("context"))]
    parts += [section("What went wrong", F.col(feedback))] if feedback else []
    return problems.join(context, by, "left").select(by, F.concat_ws("\n\n", *parts).alias("prompt"))


def gather_stats(runs: DataFrame, by: str, order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """runs + gathered, mean_so_far: number of contexts gathered and the mean of `value` so far; bucket: as running_sums() has it."""
    out = running_sums(runs, [by], order, {"gathered": F.lit(1), "_n": F.when(F.col(value).isNotNull(), 1), "_sum": F.col(value)}, bucket)
    return out.withColumn("mean_so_far", F.col("_sum") / F.col("_n")).drop("_n", "_sum")
