"""Exploration of files: scans, windows of lines, symbols, hierarchies, call graphs, scored localization, parsed outputs."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.text import basename, lines, strip
from spindrift.operators import holding
from spindrift.operators.querygen import distinct_by_lower
from spindrift.tables import cut, reading, release

SYMBOLS = "path string, kind string, name string, owner string, bases array<string>, args array<string>, calls array<string>, start_line int, end_line int"


def grep(files: DataFrame, pattern: str, id_col: str = "path", text_col: str = "content", ignore_case: bool = True, most: int | None = 50) -> DataFrame:
    """id, line, content of matching lines, ordered, the first `most`."""
    rx = ("(?i)" if ignore_case else "") + pattern
    hit = files.where(F.col(text_col).rlike(rx)).select(F.col(id_col), F.posexplode(lines(F.col(text_col))).alias("pos", "content"))
    hit = hit.where(F.col("content").rlike(rx)).select(id_col, (F.col("pos") + 1).alias("line"), "content")
    return hit.orderBy(id_col, "line").limit(most) if most else hit


def view(files: DataFrame, offset: int, limit: int, id_col: str = "path", text_col: str = "content") -> DataFrame:
    ls = lines(F.col(text_col))
    return files.select(F.col(id_col), F.size(ls).alias("total_lines"), F.array_join(F.slice(ls, offset + 1, limit), "\n").alias("content"))


def find_files(files: DataFrame, part: str, id_col: str = "path", most: int = 20) -> DataFrame:
    return files.select(id_col).where(F.contains(F.lower(id_col), F.lit(part.lower()))).orderBy(id_col).limit(most)


def file_symbols(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []

    def called(node: ast.AST) -> list[str]:
        names = (n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None for n in ast.walk(node) if isinstance(n, ast.Call))
        return sorted({n for n in names if n})

    def visit(node: ast.AST, owner: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.ClassDef):
                out.append((path, "class", n.name, owner, [ast.unparse(b) for b in n.bases], [], [], n.lineno, n.end_lineno))
                visit(n, n.name)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append((path, "method" if owner else "function", n.name, owner, [], [a.arg for a in n.args.args], called(n), n.lineno, n.end_lineno))

    visit(tree, None)
    return out


def symbols(files: DataFrame) -> DataFrame:
    """files(path, content) -> classes, methods and functions, by Python's own parser; files that don't parse have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([s for p, t in zip(pdf["path"], pdf["content"], strict=True) for s in file_symbols(p, t or "")], columns=[c.split()[0] for c in SYMBOLS.split(", ")])

    return files.select("path", "content").mapInPandas(run, SYMBOLS)


def search_symbols(table: DataFrame, name: str, kind: str | None = None, exact: bool = True, owner: str | None = None, path: str | None = None, most: int = 10) -> DataFrame:
    hit = F.col("name") == name if exact else F.contains(F.lower("name"), F.lit(name.lower()))
    out = table.where(hit)
    for c, v in (("kind", kind), ("owner", owner), ("path", path)):
        out = out.where(F.col(c) == v) if v is not None else out
    return out.orderBy("path", "start_line").limit(most)


def closure(edges: DataFrame) -> DataFrame:
    """edges(child, parent) -> child, ancestor, depth: every ancestor once, at its least depth; cycles end.

    Paths double: when all pairs up to depth d are known, a pair of depth d + 1 to 2d is one of exactly d and a known one.  So
    a chain of n edges takes log2(n) steps, and each step is a table in the shared folder, not a longer plan.
    """
    known = cut(edges.where("child is not null and parent is not null").select("child", F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(1)))
    depth = 1
    while True:
        front = known.where(F.col("depth") == depth)
        if front.isEmpty():
            return reading(known, known)
        longer = front.alias("f").join(known.alias("k"), F.col("f.ancestor") == F.col("k.child")).select("f.child", "k.ancestor", (F.col("k.depth") + depth).alias("depth"))
        new = cut(known.unionByName(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        release(known)
        known, depth = new, depth * 2


def call_edges(table: DataFrame) -> DataFrame:
    return table.where(F.col("kind") != "class").select(F.col("name").alias("caller"), F.explode("calls").alias("callee")).distinct()


#: What counts as a keyword of a problem, of the three variants: patterns in order, and the most that are taken.
_CAMEL, _SNAKE, _QUOTED = r"\b[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b", r"\b[a-z_][a-z0-9_]*\b", r"[\"']([^\"']+)[\"']"
_WORDED, _TROUBLE = r"\b[A-Z][a-zA-Z0-9]*\b", r"(?i)\b(?:error|exception|fail|bug|issue|problem)[s]?\b"
_TRACED = r"(?:Error|Exception|Traceback)[^\n]*File \"([^\"]+)\""
MOST_KEYWORDS = {"refined": 15, "layered": 20, "stepwise": 10}


def problem_keywords(text: Column, variant: str = "refined") -> Column:
    """Names, identifiers, quoted strings and the like of a problem statement, longer than two, the first of each by lower case.

    refined: identifiers with _ or over 5 long, and files of tracebacks; layered: every capitalized word, identifiers over
    3 long, words for trouble; stepwise: names and identifiers only, these with _ or over 4 long.
    """
    all_ = lambda rx, i=0: F.regexp_extract_all(text, F.lit(rx), F.lit(i))
    snake = lambda n: F.filter(all_(_SNAKE), lambda w: F.contains(w, F.lit("_")) | (F.length(w) > n))
    traced = F.transform(all_(_TRACED, 1), lambda p: F.replace(basename(p), F.lit(".py"), F.lit("")))
    found = {
        "refined": lambda: F.concat(all_(_CAMEL), snake(5), all_(_QUOTED, 1), traced),
        "layered": lambda: F.concat(all_(_WORDED), F.filter(all_(_SNAKE), lambda w: F.length(w) > 3), all_(_QUOTED, 1), all_(_TROUBLE)),
        "stepwise": lambda: F.concat(all_(_CAMEL), snake(4)),
    }[variant]()
    return F.slice(distinct_by_lower(F.filter(found, lambda w: F.length(w) > 2)), 1, MOST_KEYWORDS[variant])


def _repeated(files: DataFrame) -> DataFrame | None:
    """The values of doc that several rows have; None if there are none."""
    twice = files.groupBy(F.col("doc").alias("_twice")).agg(F.count("*").alias("_n")).where("_n > 1").select("_twice")
    return None if twice.isEmpty() else twice


def line_hits(files: DataFrame, keywords: DataFrame, id_col: str = "doc", text_col: str = "text", at_once: int = holding.AT_ONCE) -> DataFrame:
    """keywords(query, word), files -> query, doc, word, lines: number of lines of each file that hold the word, whatever its case.

    A file's lines are counted where it is read; only (file, word) rows leave the task.  Words are sent to the tasks, about at_once of them
    in one pass over the files.
    """
    words = cut(keywords.select("query", F.lower("word").alias("word")).where("word <> ''").distinct())
    plain = words.select("word").distinct()
    rows = files.select(F.col(id_col).alias("doc"), F.lower(text_col).alias("text"))
    parts = holding.passes(plain, "word", at_once)
    found = []
    for i in range(parts):
        counted = holding.line_counts(rows, plain.where(holding.part_of("word", i, parts)).toArrow()["word"].to_pylist())
        found.append(counted if parts == 1 else cut(counted))
    every = reduce(DataFrame.unionByName, found)
    if _repeated(rows) is not None:
        every = every.groupBy("doc", "word").agg(F.sum("lines").alias("lines"))
    return reading(every.join(words, "word").select("query", "doc", "word", "lines"), words, *found)


def file_scores(files: DataFrame, keywords: DataFrame, tests: DataFrame | None = None, id_col: str = "doc", text_col: str = "text", k: int = 5, layered: bool = False, at_once: int = holding.AT_ONCE) -> DataFrame:
    """keywords(query, word), tests(query, test) -> query, doc, score, rank: the k best files.

    1 for each line that holds a keyword, half a point more if the file's path does, and 2 for each file that a part of a failing test's name
    with _ or a capital names.  layered: 1.5 for a line, 2 more if the file's name holds the keyword, and 1.5 for each
    file named by a part of over 3 characters.

    Files are scored where they are read, and a batch hands on each query's k best; queries are sent to the tasks, those of about at_once
    words in one pass over the files.
    """
    line, named, part = (1.5, 2.0, 1.5) if layered else (1.0, 0.5, 2.0)
    asked = keywords.select("query", F.lower("word").alias("word")).where("word <> ''").distinct().withColumn("tested", F.lit(False))
    if tests is not None:
        parts = tests.select("query", F.explode(F.split("test", r"\.")).alias("word"))
        parts = parts.where(F.length("word") > 3 if layered else F.contains("word", F.lit("_")) | F.col("word").rlike("^[A-Z]"))
        asked = asked.unionByName(parts.select("query", F.lower("word").alias("word"), F.lit(True).alias("tested")))
    asked = cut(asked)
    path = F.lower(F.col("doc").cast("string"))
    rows = files.select(F.col(id_col).alias("doc"), F.lower(text_col).alias("text")).withColumn("path", path)
    rows = rows.withColumn("name", F.replace(basename(path), F.lit(".py"), F.lit("")) if layered else path)
    twice = _repeated(rows)
    if twice is None:
        rows = rows.withColumn("again", F.lit(False))
    else:
        rows = rows.join(twice.withColumn("again", F.lit(True)), F.col("doc").eqNullSafe(F.col("_twice")), "left").withColumn("again", F.coalesce("again", F.lit(False)))
    n = holding.passes(asked, "word", at_once)
    best = []
    for i in range(n):
        some, shared = holding.best_files(rows, asked.where(holding.part_of("query", i, n)), k, line, named, part)
        best.append(some if n == 1 else cut(some))
        if n > 1:
            shared.destroy()
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    out = reduce(DataFrame.unionByName, best).groupBy("query", "doc").agg(F.sum("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    release(asked)
    return reading(out, *best)


def _name_hits(table: DataFrame, keywords: DataFrame) -> DataFrame:
    """query, path, name, owner, kind, exact of the symbols whose lower-case name holds a keyword: by the three-character pieces of names."""
    low = F.lower("name")
    pieces = table.select(low.alias("low")).distinct().select("low", F.explode(F.when(F.length("low") >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - 2), lambda i: F.substring("low", i, F.lit(3))))).otherwise(F.array("low"))).alias("three"))
    words = keywords.select("query", "word", F.lower("word").alias("lw")).distinct()
    pairs = words.withColumn("three", F.substring("lw", 1, 3)).join(pieces, "three").where(F.contains("low", "lw")).select("query", "word", "low", "lw").distinct()
    return table.withColumn("low", low).join(pairs, "low").withColumn("exact", F.col("low") == F.col("lw"))


def symbol_scores(table: DataFrame, keywords: DataFrame, files: DataFrame | None = None, classes: DataFrame | None = None, exact: float = 2.0, partial: float = 1.0, k: int = 10) -> DataFrame:
    """keywords(query, word of two characters or more): 2 for an equal name, 1 for a name that holds the word; top k of each query.

    files(query, path): 1 more for each hit in one of these; classes(query, path, name): 1.5 more for each hit in a method of one.
    """
    hits = _name_hits(table, keywords).withColumn("score", F.when(F.col("exact"), exact).otherwise(partial))
    if files is not None:
        hits = hits.join(files.select("query", "path").distinct().withColumn("inside", F.lit(1.0)), ["query", "path"], "left").withColumn("score", F.col("score") + F.coalesce("inside", F.lit(0.0)))
    if classes is not None:
        hits = hits.join(classes.select("query", F.col("name").alias("owner")).distinct().withColumn("of", F.lit(1.5)), ["query", "owner"], "left").withColumn("score", F.col("score") + F.coalesce("of", F.lit(0.0)))
    scored = hits.groupBy("query", "path", "name", "kind", "owner").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "path", "name", "owner")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def class_scores(table: DataFrame, keywords: DataFrame, files: DataFrame, k: int = 10, top_files: int = 3) -> DataFrame:
    """Classes by keywords that begin with a capital, in files(query, path, rank) 1 more; and in the first files 0.5 and 1 for each
    keyword that the name holds."""
    kinds = table.where(F.col("kind") == "class")
    named = symbol_scores(kinds, keywords.where(F.col("word").rlike("^[A-Z]")), files, k=1 << 30).select("query", "path", "name", "score")
    first = kinds.join(files.where(F.col("rank") <= top_files).select("query", "path").distinct(), "path").select("query", "path", "name").distinct()
    held = _name_hits(kinds, keywords).join(first, ["query", "path", "name"]).groupBy("query", "path", "name").agg(F.count_distinct("lw").cast("double").alias("score"))
    scored = named.unionByName(first.withColumn("score", F.lit(0.5))).unionByName(held).groupBy("query", "path", "name").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "path", "name")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def function_scores(table: DataFrame, keywords: DataFrame, files: DataFrame, classes: DataFrame, k: int = 20) -> DataFrame:
    """Functions and methods by keywords that begin with a small letter or hold _, 1 more in files, 1.5 more in classes."""
    words = keywords.where(F.col("word").rlike("^[a-z]") | F.contains("word", F.lit("_")))
    return symbol_scores(table.where(F.col("kind") != "class"), words, files, classes, k=k)


def strata(files: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """query, stratum, path, name, relevance: functions 0.9, classes 0.8, files 0.7."""
    row = lambda d, kind, name, r: d.select("query", F.lit(kind).alias("stratum"), "path", name.alias("name"), F.lit(r).alias("relevance"))
    return row(functions, "function", F.col("name"), 0.9).unionByName(row(classes, "class", F.col("name"), 0.8)).unionByName(row(files, "file", F.lit(None).cast("string"), 0.7))


#: What names of important methods hold.
IMPORTANT = ["handle", "process", "validate", "parse", "render", "compute", "calculate", "get_", "set_", "update_"]


def structural_score(name: Column, methods: Column, file_score: Column) -> Column:
    """1, 0.5 for a name with _, 0.3 for one over 10 long, 0.1 for each of methods (an array of names), 0.2 for each kind of
    important name among them, and the file's score."""
    has = lambda p: F.exists(methods, lambda m: F.contains(m, F.lit(p)))
    some = sum((F.when(has(p), 0.2).otherwise(0.0) for p in IMPORTANT), F.lit(0.0))
    return F.lit(1.0) + F.when(F.contains(name, F.lit("_")), 0.5).otherwise(0.0) + F.when(F.length(name) > 10, 0.3).otherwise(0.0) + 0.1 * F.size(methods) + some + file_score


def located_symbols(table: DataFrame, files: DataFrame, per_file: int = 5, per_class: int = 10, k: int = 15) -> DataFrame:
    """files(query, path, score) and their symbols -> query, path, kind, name, start_line, end_line, score, relevance, rank.

    Classes of a file (the first per_file by line) with their methods, and its functions (the first per_class); the k best of each query.
    """
    methods = table.where(F.col("kind") == "method").groupBy("path", F.col("owner").alias("name")).agg(F.collect_set("name").alias("methods"))
    of_file = Window.partitionBy("query", "path", "kind").orderBy("start_line", "name")
    rows = table.where(F.col("kind") != "method").join(files.select("query", "path", F.col("score").alias("file_score")), "path").withColumn("n", F.row_number().over(of_file))
    rows = rows.where(F.col("n") <= F.when(F.col("kind") == "class", per_file).otherwise(per_class)).join(methods, ["path", "name"], "left")
    held = F.when(F.col("kind") == "class", F.coalesce("methods", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("score", F.round(structural_score(F.col("name"), held, F.col("file_score")), 6))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "path", "start_line", "name")
    out = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query", "path", "kind", "name", "start_line", "end_line", "score", F.round(relevance(F.col("score")), 6).alias("relevance"), "rank")


def relevance(score: Column) -> Column:
    return F.least(F.lit(1.0), score / 5)


def test_outcomes(output: Column) -> Column:
    """array of (test, status) of a test runner's verbose output."""
    rx = r"(?m)^(\S+::\S+)\s+(PASSED|FAILED|ERROR|SKIPPED)"
    return F.arrays_zip(F.regexp_extract_all(output, F.lit(rx), F.lit(1)).alias("test"), F.regexp_extract_all(output, F.lit(rx), F.lit(2)).alias("status"))


def test_summary(output: Column, word: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(output, rf"(\d+) {word}", 1), F.lit("")).cast("int"), F.lit(0))


def lint_rows(output: Column) -> Column:
    """array of (path, line, col, code, message)."""
    rx = r"(?m)^([^:\n]+):(\d+):(\d+): ([A-Z]\d+)(?::)? ([^\n]*)$"
    part = lambda i: F.regexp_extract_all(output, F.lit(rx), F.lit(i))
    return F.arrays_zip(part(1).alias("path"), part(2).alias("line"), part(3).alias("col"), part(4).alias("code"), part(5).alias("message"))


def repo_of_url(url: Column) -> Column:
    return F.regexp_extract(url, r"[:/]([^/:]+/[^/]+?)(?:\.git)?/?$", 1)


def commit_rows(log: Column) -> Column:
    """array of (commit, author, date, message) of a log's text: blocks that begin with commit, then Author: and Date: lines."""
    rx = r"(?m)^commit ([0-9a-f]+)[^\n]*\n(?:Merge: [^\n]*\n)?Author: +([^\n]*)\nDate: +([^\n]*)\n\n((?:    [^\n]*\n?|\n)*)"
    part = lambda i: F.regexp_extract_all(log, F.lit(rx), F.lit(i))
    said = F.transform(part(4), lambda m: strip(F.regexp_replace(m, "(?m)^    ", "")))
    return F.arrays_zip(part(1).alias("commit"), part(2).alias("author"), part(3).alias("date"), said.alias("message"))


#: What the letters of a name-status listing mean.
CHANGES = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type"}


def changed_files(output: Column) -> Column:
    """array of (change, path, old_path) of a listing of changed files: a letter, with a score for renames, and paths between tabs."""
    rx = r"(?m)^([AMDRCT])(\d*)\t([^\t\n]+)(?:\t([^\t\n]+))?$"
    part = lambda i: F.regexp_extract_all(output, F.lit(rx), F.lit(i))
    kinds = F.create_map(*(F.lit(x) for kv in CHANGES.items() for x in kv))
    rows = F.arrays_zip(part(1).alias("c"), part(3).alias("a"), part(4).alias("b"))
    return F.transform(rows, lambda r: F.struct(F.element_at(kinds, r["c"]).alias("change"), F.when(r["b"] != "", r["b"]).otherwise(r["a"]).alias("path"), F.when(r["b"] != "", r["a"]).alias("old_path")))


def branches(output: Column) -> Column:
    """array of (name, remote, current) of a listing of branches; pointers such as HEAD -> main are left out."""
    rx = r"(?m)^([* ]) (?:remotes/([^/\s]+)/)?([^\s(]+)(?: +[^\n-][^\n]*)?$"
    part = lambda i: F.regexp_extract_all(output, F.lit(rx), F.lit(i))
    rows = F.arrays_zip(part(1).alias("mark"), part(2).alias("remote"), part(3).alias("name"))
    return F.transform(rows, lambda r: F.struct(r["name"].alias("name"), F.nullif(r["remote"], F.lit("")).alias("remote"), (r["mark"] == "*").alias("current")))


def state_rows(log: DataFrame, searches: int = 10, seen: DataFrame | None = None) -> DataFrame:
    """log(instance, iteration, action, path, found): the last searches and the distinct files of each instance, without
    those of seen(instance, path), whose chunks are there already."""
    w = Window.partitionBy("instance").orderBy(F.desc("iteration"))
    last = log.where(F.col("action") == "search").withColumn("n", F.row_number().over(w)).where(F.col("n") <= searches).select("instance", F.lit("search").alias("kind"), F.col("found").alias("item"))
    files = log.where(F.col("path").isNotNull()).select("instance", "path").distinct()
    files = files.join(seen.select("instance", "path").distinct(), ["instance", "path"], "left_anti") if seen is not None else files
    return last.unionByName(files.select("instance", F.lit("file").alias("kind"), F.col("path").alias("item")))


def action_stats(log: DataFrame, by: str, action: str, ts: str, item: str) -> DataFrame:
    """by, actions, kinds, items (different ones), seconds from the first to the last: an action log folded."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return log.groupBy(by).agg(F.count("*").alias("actions"), F.count_distinct(action).alias("kinds"), F.count_distinct(item).alias("items"), ((F.max(us) - F.min(us)) / 1_000_000).alias("seconds"))


#: What an explorer does until which iteration, and when it may stop: files, classes and methods found.
BANDS = [("grep", 3), ("view_file", 6), ("search_class", 9), ("search_method", 12), ("get_class_hierarchy", 15)]
ENOUGH = {"files": 3, "classes": 1, "methods": 2}


def next_action(iteration: Column, can: dict[str, Column]) -> Column:
    """The action of an iteration: of the first band that is not over and whose action can be done (can: by action), else find_file."""
    return F.coalesce(*(F.when((iteration < end) & can[a], F.lit(a)) for a, end in BANDS), F.lit("find_file"))


def stops(iteration: Column, found: dict[str, Column], least: int = 3, most: int = 20) -> Column:
    """Whether an explorer stops: at the last iteration, or past the least with enough files, classes and methods found."""
    enough = F.lit(True)
    for k, n in ENOUGH.items():
        enough = enough & (found[k] >= n)
    return (iteration >= most) | ((iteration >= least) & enough)
