"""Table functions: what SQL text calls beside a table, row by row or over a table's partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


def chunk_function(cut: Callable[[str], Iterable[tuple[int, int]]]):
    """A table function (text) -> chunk, start, stop, content of a chunker of one's own: cut(text) gives (start, stop) in characters.
    SELECT .. FROM documents, LATERAL name(text)."""

    class Chunks:
        def eval(self, text: str) -> Iterator[tuple]:
            for n, (a, b) in enumerate(cut(text or "")):
                yield n, a, b, (text or "")[a:b]

    return udtf(Chunks, returnType="chunk int, start int, stop int, content string")


def section_function(is_head: Callable[[str], bool], most: int = 200, key: str = "long"):
    """A table function over TABLE(lines) PARTITION BY key ORDER BY line -> key, first, last, head, n_chars: sections of a key's lines, a
    new one at each head and after `most` lines.  lines has columns key (of the type named), line (number) and content.

    A partition's rows stream past: only the open section's numbers are kept, so a key may have any number of lines.
    """

    class Sections:
        def __init__(self) -> None:
            self.first: int | None = None
            self.key, self.last, self.head, self.size, self.n = None, 0, "", 0, 0

        def _done(self) -> tuple:
            return self.key, self.first, self.last, self.head, self.size

        def eval(self, row: Row) -> Iterator[tuple]:
            line, text = row["line"], row["content"] or ""
            if self.first is not None and (is_head(text) or self.n >= most):
                yield self._done()
                self.first = None
            if self.first is None:
                self.first, self.head, self.size, self.n = line, text, 0, 0
            self.key, self.last, self.size, self.n = row["key"], line, self.size + len(text), self.n + 1

        def terminate(self) -> Iterator[tuple]:
            if self.first is not None:
                yield self._done()

    return udtf(Sections, returnType=f"key {key}, first int, last int, head string, n_chars int")


def register(spark: SparkSession, name: str, function) -> None:
    spark.udtf.register(name, function)
