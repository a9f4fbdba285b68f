"""Helpers of the query modules: a registry for each module, tables, SQL fragments for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.session import share_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
                share_package(spark)
                return f(spark, sf_dir)

            queries[f.__name__] = shared
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def sql_tokens(x: str) -> str:
    """The code tokens of x, in DuckDB."""
    return rf"list_filter(list_transform(flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+|[{{}}()\[\];,.=+\-*/<>!&|]+'), lambda t: string_split(regexp_replace(regexp_replace(t, '([A-Z]+)', ' \1', 'g'), '([A-Z][a-z]+)', ' \1', 'g'), ' '))), lambda t: lower(t)), lambda t: length(t) > 1 OR regexp_full_match(t, '[0-9]'))"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_bm25(docs: str = "SELECT doc_id AS doc, text FROM documents", asked: str = "SELECT item_id AS query, text FROM benchmark", name: str = "bm25", k: int = 10, weights: tuple[tuple[str, int], ...] = (("text", 1),)) -> str:
    """CTEs that end in `name`(query, doc, score, rank)."""
    bags = " UNION ALL ".join(f"SELECT doc, unnest({sql_tokens(c)}) AS term, {w} AS n FROM {name}_d" for c, w in weights if w > 0)
    return f"""{name}_d AS ({docs}),
{name}_p AS (SELECT doc, term, sum(n)::BIGINT AS tf FROM ({bags}) GROUP BY 1, 2),
{name}_l AS (SELECT d.doc, coalesce(sum(tf), 0)::BIGINT AS dl FROM {name}_d d LEFT JOIN {name}_p p ON d.doc = p.doc GROUP BY 1),
{name}_s AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM {name}_l),
{name}_r AS (SELECT term, count(*) AS df, ln((max(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM {name}_p, {name}_s GROUP BY 1),
{name}_i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {name}_r) ELSE raw END AS idf FROM {name}_r),
{name}_q AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({sql_tokens('text')}) AS term FROM ({asked})) GROUP BY 1, 2),
{name}_h AS (SELECT query, doc, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_i USING (term) JOIN {name}_l USING (doc), {name}_s GROUP BY 1, 2),
{name} AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM {name}_h WHERE score > 0 QUALIFY rank <= {k})"""


SQL_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
