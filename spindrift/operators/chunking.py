"""Chunkers: rows of files to rows of chunks."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.text import line_number, lines, strip, windows

CHUNK_SCHEMA = "path string, chunk_type string, name string, start_line int, end_line int, imports array<string>, content string"


def line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, overlap: int = 10, least: int = 100) -> DataFrame:
    """id, chunk, start_line, end_line, content: windows of lines; those whose stripped text is shorter than least go,
    and the rest are numbered from 0."""
    at = docs.select(F.col(id_col), lines(F.col(text_col)).alias("ls")).select(id_col, "ls", F.size("ls").alias("n"))
    at = at.select(id_col, "ls", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(width - overlap))).alias("at"))
    out = at.select(id_col, (F.col("at") + 1).alias("start_line"), F.least(F.col("at") + width, "n").alias("end_line"), F.array_join(F.slice("ls", F.col("at") + 1, width), "\n").alias("content"))
    out = out.where(F.length(strip(F.col("content"))) >= least)
    return out.withColumn("chunk", F.row_number().over(Window.partitionBy(id_col).orderBy("start_line")) - 1)


def char_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1000, overlap: int = 200, least: int = 100) -> DataFrame:
    """id, start, content: windows of characters at a fixed step."""
    out = docs.select(F.col(id_col), F.inline(windows(F.col(text_col), width, overlap)))
    return out.where(F.length(strip(F.col("piece"))) >= least).withColumnRenamed("piece", "content")


def boundary_cuts(text: str, width: int = 1000, overlap: int = 200, boundaries: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[tuple[int, int]]:
    """(start, end) of windows that end behind a boundary in their last fifth; the last one ends the text.

    The kinds of boundary are asked in turn for their last place; one that is before the end found so far moves the end there.
    """
    out, at = [], 0
    while at < len(text):
        whole = end = min(at + width, len(text))
        if whole < len(text):
            low = at + int(width * 0.8)
            for b in boundaries:
                found = text.rfind(b, low, whole + len(b))
                if low < found < end:
                    end = found + len(b)
        out.append((at, end))
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def boundary_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1000, overlap: int = 200, least: int = 100) -> DataFrame:
    """As char_chunks, with ends moved to boundaries; where a window starts depends on the last one's end, so Python cuts.

    Ids pass through as they are, nulls and large ones included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s, t[s:e]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s, e in boundary_cuts(t or "", width, overlap)]
            cols = list(zip(*(r for r in rows if len(r[2].strip()) >= least), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], [id_col, "start", "content"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` long, start int, content string")


def syntax_chunks(path: str, source: str) -> list[tuple]:
    """Functions of two lines or more, classes, their methods, and the rest of the module; a syntax error gives the whole file."""
    rows = source.split("\n")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        found = [m.strip() for m in re.findall(r"(?m)^\s*((?:import|from)\s+[^\n]+)", source)]
        return [(path, "module", None, 1, len(rows), found, source)] if source.strip() else []
    imports = [ast.unparse(n) for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)]
    out, used = [], set()

    def put(node: ast.AST, kind: str, name: str) -> None:
        out.append((path, kind, name, node.lineno, node.end_lineno, imports, "\n".join(rows[node.lineno - 1 : node.end_lineno])))

    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            used.update(range(node.lineno, node.end_lineno + 1))
            if node.end_lineno > node.lineno:
                put(node, "function", node.name)
        elif isinstance(node, ast.ClassDef):
            used.update(range(node.lineno, node.end_lineno + 1))
            put(node, "class", node.name)
            for m in node.body:
                if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef):
                    put(m, "method", f"{node.name}.{m.name}")
    rest = [r for i, r in enumerate(rows, 1) if i not in used]
    if "".join(rest).strip():
        out.append((path, "module", None, 1, len(rows), imports, "\n".join(rest)))
    return out


def ast_chunks(files: DataFrame) -> DataFrame:
    """files(path, content) -> chunks, by Python's own parser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([c for p, t in zip(pdf["path"], pdf["content"], strict=True) for c in syntax_chunks(p, t or "")], columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, CHUNK_SCHEMA)


def custom_chunks(files: DataFrame, cut: Callable[[str, str], Iterable[tuple[int, int]]], id_col: str = "path", text_col: str = "content") -> DataFrame:
    """id, chunk, start, end, content of a chunker of one's own: cut(id, text) gives (start, end) in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, s, e, (t or "")[s:e]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, (s, e) in enumerate(cut(i, t or ""))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (b.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], [id_col, "chunk", "start", "end", "content"])

    given = files.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return given.mapInArrow(run, f"`{id_col}` {given.schema['id'].dataType.simpleString()}, chunk int, start int, `end` int, content string")


def with_lines(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", start: str = "start", content: str = "content") -> DataFrame:
    """chunks + start_line, end_line (from 1) of their text in docs."""
    whole = docs.select(F.col(id_col), F.col(text_col).alias("_whole"))
    out = chunks.join(whole, id_col)
    return out.withColumn("start_line", line_number(F.col("_whole"), F.col(start))).withColumn("end_line", line_number(F.col("_whole"), F.col(start) + F.length(content))).drop("_whole")
