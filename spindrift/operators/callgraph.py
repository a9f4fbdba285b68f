"""Who calls whom: names are looked up in scopes, imports and classes by joins; callers of callers by closure."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.operators.explore import closure
from spindrift.tables import cut, reading, release

#: scope: the qualified name of what encloses it, '' for the module; owner: of the innermost class around it.
FACTS = "path string, fact string, scope string, owner string, name string, kind string, receiver string, bases array<string>, start_line int, end_line int"


def module_name(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def file_facts(path: str, source: str) -> list[tuple]:
    """Definitions, calls and imports of a file; one that doesn't parse has none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple] = []
    module = module_name(path)
    package = module if path.endswith("__init__.py") else module.rpartition(".")[0]

    def dotted(n: ast.AST) -> str | None:
        """A name, a chain of attributes, or either called without arguments mattering: C() is what a call of C gives."""
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute):
            base = dotted(n.value)
            return None if base is None or base.endswith("()") else f"{base}.{n.attr}"
        if isinstance(n, ast.Call):
            base = dotted(n.func)
            return None if base is None or base.endswith("()") else f"{base}()"
        return None

    def put(fact: str, n: ast.AST, scope: str, owner: str | None, name: str, kind: str | None = None, receiver: str | None = None, bases: tuple = ()) -> None:
        out.append((path, fact, scope, owner, name, kind, receiver, list(bases), n.lineno, n.end_lineno))

    def visit(n: ast.AST, scope: str, owner: str | None) -> None:
        if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            is_class = isinstance(n, ast.ClassDef)
            kind = "class" if is_class else "method" if scope and scope == owner else "function"
            put("def", n, scope, owner, n.name, kind, None, [b for b in map(dotted, n.bases) if b] if is_class else ())
            for d in [*n.decorator_list, *(n.bases if is_class else [])]:
                visit(d, scope, owner)
            inner = f"{scope}.{n.name}" if scope else n.name
            for c in [*n.body, *([] if is_class else [n.args])]:
                visit(c, inner, inner if is_class else owner)
            return
        if isinstance(n, ast.Import):
            for a in n.names:
                put("import", n, scope, owner, "", "module", a.asname or a.name, [a.name])
        elif isinstance(n, ast.ImportFrom):
            above = package.split(".")[: len(package.split(".")) - n.level + 1] if n.level else []
            source = ".".join([*filter(None, above), *([n.module] if n.module else [])])
            for a in n.names:
                put("import", n, scope, owner, a.name, "name", a.asname or a.name, [source])
        elif isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name) and f.id != "super":
                put("call", n, scope, owner, f.id)
            elif isinstance(f, ast.Attribute):
                put("call", n, scope, owner, f.attr, None, dotted(f.value) or "?")
        for c in ast.iter_child_nodes(n):
            visit(c, scope, owner)

    visit(tree, "", None)
    return out


def facts(files: DataFrame) -> DataFrame:
    """files(path, content) -> definitions, calls and imports, each file parsed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([f for p, t in zip(pdf["path"], pdf["content"], strict=True) for f in file_facts(p, t or "")], columns=[c.split()[0] for c in FACTS.split(", ")])

    return files.select("path", "content").mapInPandas(run, FACTS)


def node(path: Column, scope: Column, name: Column | None = None) -> Column:
    """path:qualified name; path alone is the module."""
    whole = scope if name is None else F.concat_ws(".", F.nullif(scope, F.lit("")), name)
    return F.concat(path, F.lit(":"), whole)


def _module(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"(?:/__init__)?\.py$", ""), F.lit("/"), F.lit("."))


def _lookup(asked: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """asked(key, path, scope, word) -> key, target (a node), kind, how: what a plain name means there.

    Of the definitions of that name in the file whose scope is one of a function around the place, or the module, the innermost; else what is
    imported under it.  Names of a class body aren't seen from its methods.
    """
    d = defs.select("path", F.col("name").alias("word"), F.col("scope").alias("def_scope"), "kind", "node")
    around = (F.col("def_scope") == "") | (F.col("scope") == F.col("def_scope")) | F.col("scope").startswith(F.concat(F.col("def_scope"), F.lit(".")))
    inner = Window.partitionBy("key").orderBy(F.desc(F.length("def_scope")), "node")
    # What is defined in a class body is a method or a class with an owner equal to its scope.
    local = asked.join(d.join(defs.where("kind = 'class'").select("path", F.col("qual").alias("def_scope"), F.lit(True).alias("in_class")), ["path", "def_scope"], "left").where("in_class is null"), ["path", "word"]).where(around)
    local = local.withColumn("n", F.row_number().over(inner)).where("n = 1").select("key", F.col("node").alias("target"), "kind", F.lit("local").alias("how"))
    rest = asked.join(local.select("key"), "key", "left_anti")
    names = imports.where("kind = 'name'").select("path", F.col("receiver").alias("word"), F.element_at("bases", 1).alias("module"), F.col("name").alias("there"))
    top = defs.where("scope = ''").select(_module(F.col("path")).alias("module"), F.col("name").alias("there"), "node", "kind")
    w = Window.partitionBy("key").orderBy("node")
    far = rest.join(names, ["path", "word"]).join(top, ["module", "there"]).withColumn("n", F.row_number().over(w)).where("n = 1")
    return local.unionByName(far.select("key", F.col("node").alias("target"), "kind", F.lit("imported").alias("how")))


def ancestors(defs: DataFrame, imports: DataFrame) -> DataFrame:
    """node, ancestor, depth of classes, each its own at depth 0; bases by name, import, or module.Name."""
    bases = defs.where("kind = 'class'").select(F.col("node").alias("child"), "path", "scope", F.posexplode("bases").alias("pos", "base"))
    bases = bases.withColumn("key", F.concat(F.col("child"), F.lit("#"), F.col("pos").cast("string")))
    plain = _lookup(bases.where(~F.contains("base", F.lit("."))).select("key", "path", "scope", F.col("base").alias("word")), defs, imports).where("kind = 'class'").select("key", "target")
    spelled = bases.where(F.contains("base", F.lit("."))).select("key", "path", F.regexp_extract("base", r"^(.*)\.", 1).alias("receiver"), F.regexp_extract("base", r"([^.]+)$", 1).alias("name"))
    far = _by_module(spelled, defs, imports).select("key", "target")
    edges = bases.join(plain.unionByName(far), "key").select("child", F.col("target").alias("parent"))
    closed = closure(edges)
    known = closed.select(F.col("child").alias("node"), "ancestor", "depth")
    own = defs.where("kind = 'class'").select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    out = cut(own.unionByName(known).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
    release(closed)
    return out


def _by_module(asked: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """asked(key, path, receiver, name): the module's definition of the name, if receiver is an imported module."""
    modules = imports.select("path", "receiver", F.when(F.col("kind") == "module", F.element_at("bases", 1)).otherwise(F.concat_ws(".", F.element_at("bases", 1), "name")).alias("module")).distinct()
    top = defs.where("scope = ''").select(_module(F.col("path")).alias("module"), "name", F.col("node").alias("target"), "kind")
    w = Window.partitionBy("key").orderBy("target")
    return asked.join(modules, ["path", "receiver"]).join(top, ["module", "name"]).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def resolve(table: DataFrame) -> DataFrame:
    """facts -> path, caller, line, receiver, name, callee, how: a row for each call.

    caller and callee are nodes, path:qualified name; callee is null and how 'unknown' where the name isn't one of the files'.  how: local
    or imported (a plain name), self, super (a method of the class around it, or of its nearest base), module (of an imported module),
    class (of a class, or of what a call of the class gives).  All look-ups are equality joins on a path and a name, or on a class.
    """
    kept = cut(table)
    defs = kept.where("fact = 'def'").withColumn("qual", F.concat_ws(".", F.nullif("scope", F.lit("")), "name")).withColumn("node", node(F.col("path"), F.col("qual")))
    imports = kept.where("fact = 'import'")
    calls = kept.where("fact = 'call'").select("path", "scope", "owner", "receiver", "name", F.col("start_line").alias("line")).distinct()
    calls = cut(calls.withColumn("key", F.concat_ws("|", "path", "scope", F.col("line").cast("string"), F.coalesce("receiver", F.lit("")), "name")))
    lineage = ancestors(defs, imports)
    methods = defs.where("kind = 'method'").select(node(F.col("path"), F.col("scope")).alias("ancestor"), "name", F.col("node").alias("target"))

    def method(asked: DataFrame, least: int, how: str) -> DataFrame:
        """asked(key, node, name): the method of the nearest ancestor from `least` steps up."""
        w = Window.partitionBy("key").orderBy("depth", "target")
        hits = asked.join(lineage.where(F.col("depth") >= least), "node").join(methods, ["ancestor", "name"])
        return hits.withColumn("n", F.row_number().over(w)).where("n = 1").select("key", "target", F.lit(how).alias("how"))

    plain = _lookup(calls.where("receiver is null").select("key", "path", "scope", F.col("name").alias("word")), defs, imports).select("key", "target", "how")
    inside = calls.where("owner is not null").withColumn("node", node(F.col("path"), F.col("owner")))
    own = method(inside.where("receiver in ('self', 'cls')").select("key", "node", "name"), 0, "self")
    above = method(inside.where("receiver = 'super()'").select("key", "node", "name"), 1, "super")
    rest = calls.where("receiver is not null and receiver not in ('self', 'cls', 'super()', '?')")
    modules = _by_module(rest.select("key", "path", "receiver", "name"), defs, imports).select("key", "target", F.lit("module").alias("how"))
    named = rest.select("key", "path", "scope", F.regexp_replace("receiver", r"\(\)$", "").alias("word"), "name")
    classes = _lookup(named.select("key", "path", "scope", "word"), defs, imports).where("kind = 'class'").select("key", F.col("target").alias("node"))
    of_class = method(named.select("key", "name").join(classes, "key"), 0, "class")
    found = plain.unionByName(own).unionByName(above).unionByName(modules).unionByName(of_class)
    out = calls.join(found, "key", "left").select("path", node(F.col("path"), F.col("scope")).alias("caller"), "line", "receiver", "name", F.col("target").alias("callee"), F.coalesce("how", F.lit("unknown")).alias("how"))
    return reading(out, kept, calls, lineage)


def reach(resolved: DataFrame) -> DataFrame:
    """function, callers, callees (direct, distinct), all_callers, all_callees (through others too, itself included where it comes back)."""
    edges = resolved.where("callee is not null").select(F.col("caller").alias("child"), F.col("callee").alias("parent")).distinct()
    known = closure(edges)
    side = lambda by, other, names: known.groupBy(F.col(by).alias("function")).agg(F.count(F.when(F.col("depth") == 1, F.col(other))).alias(names[0]), F.count(other).alias(names[1]))
    down, up = side("child", "ancestor", ("callees", "all_callees")), side("ancestor", "child", ("callers", "all_callers"))
    out = down.join(up, "function", "full").select("function", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "callees", "all_callers", "all_callees")))
    return reading(out, known, resolved)
