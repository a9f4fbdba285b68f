"""python -m spindrift: list and run queries, build and search an index, compare methods, estimate costs, write a report."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

VERSION = "0.2"
CONFIG = {"preset": "minimal", "data": "data", "output": "results"}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindrift", description=__doc__)
    p.add_argument("--master", help="Spark master; spark-submit's if not given")
    sub = p.add_subparsers(dest="command", required=True)
    one = lambda name, text: sub.add_parser(name, help=text)
    one("version", "print the version")
    one("list", "names of queries and registered operators")
    c = one("init", "write a configuration")
    c.add_argument("path")
    c = one("run", "run a query over a folder of tables and write its rows")
    c.add_argument("query")
    c.add_argument("data")
    c.add_argument("out")
    c = one("index", "build a BM25 index of a Parquet table")
    for a in ("docs", "out"):
        c.add_argument(a)
    c.add_argument("--id", default="doc_id")
    c.add_argument("--text", default="text")
    c = one("search", "the best documents of an index for a query")
    for a in ("index", "query"):
        c.add_argument(a)
    c.add_argument("-k", type=int, default=10)
    for name, text in (("evaluate", "rates of results (method, instance, resolved, applied, seconds, tokens)"), ("compare", "methods of results side by side"), ("report", "a report of results")):
        c = one(name, text)
        c.add_argument("results")
        c.add_argument("--json", action="store_true")
    c = one("estimate-cost", "what a run would cost")
    c.add_argument("instances", type=int)
    c.add_argument("model")
    c.add_argument("--methods", type=int, default=1)
    c.add_argument("--iterations", type=int, default=1)
    return p


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    if a.command == "version":
        print(VERSION)
    elif a.command == "init":
        if os.path.exists(a.path):
            print(f"{a.path} is there already", file=sys.stderr)
            return 1
        with open(a.path, "w") as f:
            json.dump(CONFIG, f, indent=2)
    elif a.command == "list":
        from spindrift import library
        from spindrift.plans import catalog

        print("queries:", *sorted(catalog.QUERIES))
        for kind, named in library.OWN.items():
            print(f"{kind}:", *named)
    elif a.command == "estimate-cost":
        from spindrift.operators import metrics

        print(json.dumps(metrics.estimate(a.instances, a.model, methods=a.methods, iterations=a.iterations)))
    else:
        _with_spark(a)
    return 0


def _with_spark(a: argparse.Namespace) -> None:
    from spindrift.operators import report, sparse
    from spindrift.plans import catalog
    from spindrift.session import build

    spark = build(master=a.master)
    if a.command == "run":
        if a.query not in catalog.QUERIES:
            raise SystemExit(f"no query named {a.query}")
        catalog.QUERIES[a.query](spark, a.data).write.parquet(a.out)
    elif a.command == "index":
        sparse.build(spark.read.parquet(a.docs), a.id, {a.text: 1}).save(a.out)
    elif a.command == "search":
        asked = spark.range(1).select(F.col("id").alias("item_id"), F.lit(a.query).alias("text"))
        for r in sparse.search_index(sparse.Index.load(spark, a.index), asked, a.k).orderBy("rank").collect():  # k rows
            print(r["rank"], r["doc"], r["score"])
    else:
        results = spark.read.parquet(a.results)
        tables = {"methods": report.compare(results)}
        if a.command != "evaluate":
            tables |= {"summary": report.summary(results), "intervals": report.wilson(results), "pairs": report.pairwise(results)}
        print((report.as_json if a.json else report.markdown)(a.command, tables))


if __name__ == "__main__":
    sys.exit(main())
