"""Outcome and similarity metrics as expressions and grouped aggregations."""

from __future__ import annotations

import ast
import hashlib
import keyword
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.text import lines, strip
from spindrift.operators.running import running_sums

#: Words that make a task hard or easy.
HARD = ["refactor", "architecture", "redesign", "complex", "multiple"]
EASY = ["typo", "simple", "minor", "documentation", "comment"]
#: Dollars for a thousand prompt and completion tokens.
PRICES = {"gpt-4": (0.03, 0.06), "gpt-4-turbo": (0.01, 0.03), "gpt-4o": (0.005, 0.015), "gpt-4o-mini": (0.00015, 0.0006), "gpt-3.5-turbo": (0.0005, 0.0015)}
COST_PER_1K = 0.02


def difficulty(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("|".join(HARD)), "hard").when(low.rlike("|".join(EASY)), "easy").otherwise("medium")


def complexity(text: Column, chunks: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("|".join(HARD)), "high").when(low.rlike("|".join(EASY)), "low").when(chunks > 10, "high").when(chunks < 3, "low").otherwise("medium")


def error_category(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("syntax|indentation"), "syntax").when(low.rlike("test|assert"), "test_failure").when(low.rlike("apply|patch"), "apply_error").when(low.rlike("type|name|attribute|import"), "semantic").otherwise("unknown")


def confidence(iterations: Column, resolved: Column) -> Column:
    return F.when(~resolved, 0.0).when(iterations <= 1, 0.9).when(iterations == 2, 0.7).otherwise(0.5)


def resolved_by_tests(f2p: Column, p2p: Column, passed: Column, failed: Column) -> Column:
    """All must-pass tests passed and none that passed before failed."""
    return (F.size(F.array_except(f2p, passed)) == 0) & (F.size(F.array_except(p2p, passed)) == 0) & ~F.arrays_overlap(p2p, failed)


def patch_format_ok(patch: Column) -> Column:
    return F.contains(patch, F.lit("---")) & F.contains(patch, F.lit("+++"))


def patch_syntax_ok(patch: Column) -> Column:
    """At least one hunk header, and only hunk lines after the first."""
    head = r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"
    body = F.substring(patch, F.greatest(F.instr(patch, "@@"), F.lit(1)), F.length(patch))
    return patch.rlike("(?m)" + head) & F.forall(lines(body), lambda x: (x == "") | x.rlike(r"^(?:[-+ @\\]|diff |index )"))


def resolution(rows: DataFrame, resolved: str, sets: list[list[str]]) -> DataFrame:
    """Totals and rates of each grouping set, in one pass."""
    names = sorted({c for s in sets for c in s})
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *names)
    total = F.count("*")
    return grouped.agg(total.alias("total"), F.sum(F.col(resolved).cast("int")).alias("resolved"), (total - F.sum(F.col(resolved).cast("int"))).alias("unresolved"), F.round(F.avg(F.col(resolved).cast("double")) * 100, 6).alias("rate"))


def pass_at_k(attempts: DataFrame, by: str, attempt: str, resolved: str, ks: tuple[int, ...]) -> DataFrame:
    """For each instance whether any of its first k attempts resolved it; null if it has fewer than k."""
    n = attempts.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(attempt)))
    cols = [F.when(F.count("*") >= k, F.max((F.col(resolved) & (F.col("_n") <= k)).cast("int"))).alias(f"pass_at_{k}") for k in ks]
    return n.groupBy(by).agg(F.count("*").alias("num_attempts"), F.max(F.col(resolved).cast("int")).alias("any_resolved"), *cols)


# Localization: gold and pred are arrays, pred in rank order


def recall_at(gold: Column, pred: Column, k: int) -> Column:
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, F.slice(pred, 1, k))) / F.size(g) * 100).otherwise(0.0)


def hit_at(gold: Column, pred: Column, k: int) -> Column:
    return F.when(F.arrays_overlap(gold, F.slice(pred, 1, k)), 100.0).otherwise(0.0)


def mrr(gold: Column, pred: Column) -> Column:
    one = lambda g: F.when(F.array_contains(pred, g), 1 / F.array_position(pred, g).cast("double")).otherwise(0.0)
    return F.when(F.size(gold) > 0, F.aggregate(F.transform(gold, one), F.lit(0.0), lambda s, x: s + x) / F.size(gold)).otherwise(0.0)


def top_k_accuracy(gold: Column, pred: Column, k: int) -> Column:
    return F.size(F.array_except(gold, F.slice(pred, 1, k))) == 0


def line_accuracy(gold: DataFrame, ranges: DataFrame, by: str, tolerance: int = 3) -> DataFrame:
    """gold(by, line), ranges(by, first, last): the share of gold lines within tolerance of a range.

    A range lies in one or two bins whose width is the power of two not below its length; a line is looked up in its bin of
    every width that occurs, at most 63.  So the range join is by equality on few rows, however wide the ranges are.
    """
    wide = ranges.select(by, (F.col("first") - tolerance).cast("long").alias("lo"), (F.col("last") + tolerance).cast("long").alias("hi")).where("lo <= hi")
    wide = wide.withColumn("level", F.ceil(F.log2((F.col("hi") - F.col("lo") + 1).cast("double"))).cast("int"))
    levels = sorted(r[0] for r in wide.select("level").distinct().collect())
    at = lambda x, level: F.call_function("shiftright", F.col(x), F.col(level))
    bins = wide.select(by, "lo", "hi", "level", F.explode(F.array_distinct(F.array(at("lo", "level"), at("hi", "level")))).alias("bin")).distinct()
    lines_ = gold.select(by, F.col("line").cast("long").alias("line")).distinct()
    asked = lines_.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("bin", at("line", "level"))
    near = asked.join(bins, [by, "level", "bin"]).where("line between lo and hi").select(by, "line").distinct()
    hit = lines_.join(near.withColumn("hit", F.lit(1)), [by, "line"], "left")
    return hit.groupBy(by).agg(F.count("*").alias("gold_lines"), F.count("hit").alias("hit_lines"), F.round(F.count("hit") / F.count("*") * 100, 6).alias("line_accuracy"))


def file_sets(rows: DataFrame, by: str, order: list[str], gold: str, pred: str, bucket: Column | None = None) -> DataFrame:
    """by, order, exact, running_rate: whether gold and predicted files are the same set, and the share so far, percent."""
    same = F.sort_array(F.array_distinct(gold)) == F.sort_array(F.array_distinct(pred))
    out = running_sums(rows.select(by, *order, same.alias("exact")), [by], order, {"_n": F.when(F.col("exact").isNotNull(), 1), "_k": F.col("exact").cast("int")}, bucket)
    return out.withColumn("running_rate", F.round(F.col("_k") / F.col("_n") * 100, 6)).drop("_n", "_k")


def localization(rows: DataFrame, by: list[str], gold: str, pred: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """by, recall_k and hit_k of each k, mrr, score (recall at 5)."""
    g, p = F.col(gold), F.col(pred)
    at = [x for k in ks for x in (F.round(recall_at(g, p, k), 6).alias(f"recall_{k}"), hit_at(g, p, k).alias(f"hit_{k}"))]
    return rows.select(*by, *at, F.round(mrr(g, p), 6).alias("mrr"), F.round(recall_at(g, p, 5), 6).alias("score"))


def test_pass_rate(passed: Column, failed: Column, percent: bool = False) -> Column:
    """Passed tests as a share of those that ran; none ran: 0."""
    n = F.size(passed) + F.size(failed)
    return F.when(n > 0, F.size(passed) / n * (100 if percent else 1)).otherwise(0.0)


def resolved_lightly(patch: Column) -> Column:
    """Where no tests can be run: a patch that has the form of one and whose hunks are well formed."""
    return F.coalesce(patch_format_ok(patch) & patch_syntax_ok(patch), F.lit(False))


def custom(rows: DataFrame, value: Column, folds: dict[str, Callable[[Column], Column]], by: list[str] | None = None) -> DataFrame:
    """A metric of one's own: a value of each row and aggregates of it, by name."""
    return rows.select(*(by or []), value.alias("_value")).groupBy(*(by or [])).agg(*(f(F.col("_value")).alias(n) for n, f in folds.items()))


def aggregate(rows: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """by, metric, mean, least, most, n of numeric columns in long form; nulls don't count, a metric without values has n = 0."""
    by = by or []
    named = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    long = rows.select(*by, F.inline(named))
    return long.groupBy(*by, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"))


# Code similarity


def clipped_ngrams(ref: Column, hyp: Column, n_max: int = 4) -> Column:
    """For each n up to n_max the n-grams of hyp that ref has too, each counted as often as ref has it at most.  Null counts as no tokens.

    Counted row by row on numbers for the tokens, so no n-gram leaves its task and only one pair's are held at a time.
    """

    @F.arrow_udf("array<long>")
    def run(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        codes = pa.concat_arrays([ref.flatten(), hyp.flatten()]).dictionary_encode(null_encoding="encode").indices.to_numpy()
        ends = np.cumsum([0, *(n or 0 for a in (ref, hyp) for n in pc.list_value_length(a).to_pylist())])
        out = []
        for i in range(len(ref)):
            j = i + len(ref)
            r, h = codes[ends[i] : ends[i + 1]], codes[ends[j] : ends[j + 1]]
            same = [0] * n_max
            tokens = np.unique(np.concatenate([r, h]), return_inverse=True)[1].astype(np.int64)
            r, h = tokens[: len(r)], tokens[len(r) :]
            a, b = r, h
            for n in range(1, min(len(r), len(h), n_max) + 1):
                if n > 1:  # the (n-1)-gram's number and the token after it
                    a, b = a[:-1] * len(tokens) + r[n - 1 :], b[:-1] * len(tokens) + h[n - 1 :]
                names, number = np.unique(np.concatenate([a, b]), return_inverse=True)
                a, b = number[: len(a)], number[len(a) :]
                same[n - 1] = int(np.minimum(np.bincount(a, minlength=len(names)), np.bincount(b, minlength=len(names))).sum())
            out.append(same)
        return pa.array(out, pa.list_(pa.int64()))

    return run(ref, hyp)


def ngram_score(same: Column, refs: Column, hyps: Column, n_max: int = 4) -> Column:
    """The score of ngram_overlap, of clipped_ngrams() and the numbers of both sides' tokens."""
    total = lambda n: hyps - n + 1
    logs = [F.when((total(n) > 0) & (same[n - 1] > 0), F.log(same[n - 1] / total(n))).otherwise(0.0) for n in range(1, n_max + 1)]
    brevity = F.when(refs > 0, F.least(F.lit(1.0), hyps / refs)).otherwise(0.0)
    return F.round(F.when(same[0] > 0, F.exp(sum(logs, F.lit(0.0)) / n_max) * brevity).otherwise(0.0), 6)


def ngram_overlap(pairs: DataFrame, key: str, ref: str, hyp: str, n_max: int = 4) -> DataFrame:
    """key, score: the geometric mean over n of clipped n-gram precision of hyp against ref, times the brevity factor.

    pairs(key, ref, hyp) hold token arrays; each row is scored where it is, nothing is shuffled.  A zero precision counts as 1 in the mean.
    """
    counted = pairs.select(key, clipped_ngrams(F.col(ref), F.col(hyp), n_max).alias("_same"), F.size(ref).alias("_r"), F.size(hyp).alias("_h"))
    return counted.select(key, ngram_score(F.col("_same"), F.col("_r"), F.col("_h"), n_max).alias("score"))


def line_jaccard(a: Column, b: Column) -> Column:
    sets = [F.array_distinct(F.filter(F.transform(lines(x), strip), lambda s: s != "")) for x in (a, b)]
    union = F.size(F.array_union(*sets))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(*sets)) / union)


def char_similarity(a: Column, b: Column) -> Column:
    """The characters of a that occur in b, as a share of the longer length; what b has is looked up once for each different character."""
    longest = F.greatest(F.length(a), F.length(b))
    # Characters that b lacks are those of a without b's; deleting them from a leaves the ones that count.
    lacking = F.array_join(F.array_except(F.split(a, ""), F.split(b, "")), "")
    return F.when(longest == 0, 1.0).otherwise(F.length(F.call_function("translate", a, lacking, F.lit(""))) / longest)


def token_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _parsed(code: str | None) -> ast.AST | None:
    try:
        return ast.parse(code or "")
    except (SyntaxError, ValueError):
        return None


def node_types(code: str | None) -> list[str] | None:
    tree = _parsed(code)
    return None if tree is None else _types(tree)


def _types(tree: ast.AST) -> list[str]:
    return [type(n).__name__ for n in ast.walk(tree)]


def data_flow(code: str | None) -> set[tuple] | None:
    """(name, how it is used) of each variable."""
    tree = _parsed(code)
    return None if tree is None else _flow(tree)


def _flow(tree: ast.AST) -> set[tuple]:
    uses: dict[str, set[str]] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Name):
            uses.setdefault(n.id, set()).add(type(n.ctx).__name__)
    return {(k, frozenset(v)) for k, v in uses.items()}


def code_match(ref: Column, hyp: Column) -> Column:
    """struct of the positional agreement of syntax node types (null if one doesn't parse: codebleu() then has the n-gram
    overlap) and the Jaccard index of variable uses (0 if one doesn't parse or has none)."""

    @F.pandas_udf("struct<syntax_match:double, flow_match:double>")
    def run(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        out = []
        for r, h in zip(ref, hyp, strict=True):
            trees = _parsed(r), _parsed(h)  # each side is parsed once
            if None in trees:
                out.append((None, 0.0))
                continue
            (a, b), (f, g) = map(_types, trees), map(_flow, trees)
            same = sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b), 1)
            out.append((same, len(f & g) / len(f | g) if f and g else 0.0))
        return pd.DataFrame(out, columns=["syntax_match", "flow_match"])

    return run(ref, hyp)


KEYWORDS = frozenset(keyword.kwlist)


def keyword_weighted(tokens: Column) -> Column:
    """Tokens with Python's keywords twice, for a keyword-weighted n-gram overlap."""
    return F.flatten(F.transform(tokens, lambda t: F.when(t.isin(sorted(KEYWORDS)), F.array(t, t)).otherwise(F.array(t))))


def codebleu(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted mean of parts; a syntax match of code that doesn't parse is its plain n-gram overlap."""
    total = sum(weights[k] for k in parts)
    if "syntax" in parts and "ngram" in parts:
        parts = parts | {"syntax": F.coalesce(parts["syntax"], parts["ngram"])}
    return sum((F.coalesce(c, F.lit(0.0)) * (weights[k] / total) for k, c in parts.items()), F.lit(0.0))


# Diversity


def syntax_signature(code: Column) -> Column:
    """The sequence of syntax node types, hashed; the text's own hash where it doesn't parse."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: hashlib.md5(" ".join(node_types(c) or [c or ""]).encode()).hexdigest()[:16])

    return run(code)


def signature(code: Column, kind: str = "line") -> Column:
    """line: an MD5 of the sorted distinct stripped lines; token: of identifiers' shape."""
    if kind == "line":
        return F.substring(F.md5(F.array_join(F.sort_array(F.array_distinct(F.filter(F.transform(lines(code), strip), lambda x: x != ""))), "\n")), 1, 16)
    return F.substring(F.md5(F.array_join(F.regexp_extract_all(code, F.lit(r"[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0)), " ")), 1, 16)


def cluster_entropy(rows: DataFrame, by: str, sig: str) -> DataFrame:
    """Clusters of equal signatures: their number, normalized entropy, Gini-Simpson diversity and largest size."""
    sizes = rows.groupBy(by, sig).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(by))
    sizes = sizes.withColumn("p", p)
    m = F.count("*")
    entropy = F.when(m > 1, F.sum(-F.col("p") * F.log("p")) / F.log(m.cast("double"))).otherwise(0.0)
    return sizes.groupBy(by).agg(F.sum("c").alias("members"), m.alias("clusters"), F.round(entropy, 6).alias("entropy"), F.round(1 - F.sum(F.col("p") * F.col("p")), 6).alias("diversity"), F.max("c").alias("largest"))


def perplexity(rows: DataFrame, by: str, logprob: str) -> DataFrame:
    return rows.groupBy(by).agg(F.round(F.exp(-F.avg(logprob)), 6).alias("perplexity"))


# Tokens and cost


def price(model: Column, side: int, first_match: bool = False) -> Column:
    """Dollars per thousand tokens of the longest price name that the model's name contains (first_match: of the first)."""
    names = list(PRICES) if first_match else sorted(PRICES, key=lambda n: -len(n))
    out = None
    for n in names:
        hit = F.contains(model, F.lit(n))
        out = F.when(hit, PRICES[n][side]) if out is None else out.when(hit, PRICES[n][side])
    return out.otherwise(F.lit(COST_PER_1K))


def cost(model: Column, prompt: Column, completion: Column, first_match: bool = False) -> Column:
    return prompt / 1000 * price(model, 0, first_match) + completion / 1000 * price(model, 1, first_match)


def estimate(instances: int, model: str, prompt: int = 2000, completion: int = 1000, methods: int = 1, iterations: int = 1) -> dict:
    """What a run costs: dollars for one instance and in all, tokens in all."""
    a, b = PRICES[max((n for n in PRICES if n in model), key=len)] if any(n in model for n in PRICES) else (COST_PER_1K, COST_PER_1K)
    one, runs = (prompt / 1000 * a + completion / 1000 * b) * iterations, instances * methods
    return {"model": model, "runs": runs, "cost_per_instance": one, "total_cost": one * runs, "prompt_tokens": prompt * runs * iterations, "completion_tokens": completion * runs * iterations}


def dollars(amount: Column) -> Column:
    """As text, with more places for small amounts."""
    return F.concat(F.lit("$"), F.when(amount < 0.01, F.format_string("%.6f", amount)).when(amount < 1, F.format_string("%.4f", amount)).otherwise(F.format_string("%.2f", amount)))


def erfc(x: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else math.erfc(v))

    return run(x)
