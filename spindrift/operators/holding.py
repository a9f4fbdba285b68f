"""Words that lines hold, counted where files are read: a task meets the words with the distinct identifiers of a line, and hands on counts,
or each query's best files, not lines and identifiers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from spindrift.operators import blocks

#: Words that meet the files in one pass about, each counted once for every 32 bytes begun.
AT_ONCE = 1 << 15
#: Identifiers whose words a task remembers; then it begins anew.
REMEMBERED = 1 << 19
_IDENTIFIERS = re.compile("[a-z0-9_]+").findall


class Pieces(dict):
    """string -> numbers of the words that it holds, by the words' first three characters at each of its places; remembered."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        sizes: dict[str, set[int]] = {}
        for w in number:
            sizes.setdefault(w[:3], set()).add(len(w))
        self.number, self.begin, self.widths = number, {b: tuple(z) for b, z in sizes.items()}, sorted({len(b) for b in sizes})

    def __missing__(self, s: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found, begin, at = set(), self.begin.get, self.number.get
        for width in self.widths:
            for i in range(len(s) - width + 1):
                for size in begin(s[i : i + width], ()):
                    found.add(at(s[i : i + size]))
        found.discard(None)
        out = self[s] = tuple(found)
        return out


class Words:
    """Distinct lower-case words by number.  One that is an identifier is held by a line if one of the line's identifiers holds it; another is
    looked for where a file holds the longest identifier in it."""

    def __init__(self, words: list[str]):
        self.words, number = words, {}
        self.within, self.loose = {}, []
        for i, w in enumerate(words):
            inside = max(_IDENTIFIERS(w), key=len, default="")
            if inside == w:
                number[w] = i
        for i, w in enumerate(words):
            inside = max(_IDENTIFIERS(w), key=len, default="")
            if not inside:
                self.loose.append(i)
            elif inside != w:
                self.within.setdefault(number.setdefault(inside, len(words) + len(number)), []).append(i)
        self.of_identifier, self.of_name = Pieces(number), Pieces({w: i for i, w in enumerate(words)})

    def lines(self, text: str) -> dict[int, int]:
        """number of each word that the text's lines hold -> the number of these lines."""
        ls, counts = text.split("\n"), Counter()
        for x in ls:
            counts.update(set().union(*map(self.of_identifier.__getitem__, set(_IDENTIFIERS(x)))))
        for i in [*self.loose, *(i for a in self.within.keys() & counts.keys() for i in self.within[a])]:
            w = self.words[i]
            if w in text and (n := sum(w in x for x in ls)):
                counts[i] = n
        return {i: n for i, n in counts.items() if i < len(self.words)} if self.within else counts


def part_of(col: str, part: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(parts)) == part


def passes(rows: DataFrame, col: str, at_once: int) -> int:
    return max(1, -(-(rows.agg(F.sum(F.ceil(F.octet_length(col) / 32))).first()[0] or 0) // at_once))


def _texts(column: pa.Array) -> Iterator[str | None]:
    return (v.as_py() for v in column)


def line_counts(files: DataFrame, words: list[str]) -> DataFrame:
    """files(doc, text in lower case) -> doc, word, lines: a row for each word that lines of a row's text hold."""
    shared = files.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = Words(shared.value), pa.array(shared.value, pa.string())
        for batch in batches:
            doc, word, lines = [], [], []
            for i, text in enumerate(_texts(batch.column("text"))):
                counts = held.lines(text) if text else {}
                doc += [i] * len(counts)
                word += counts.keys()
                lines += counts.values()
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(doc, pa.int64())), names.take(pa.array(word, pa.int64())), pa.array(lines, pa.int64())], ["doc", "word", "lines"])

    return files.select("doc", "text").mapInArrow(run, StructType([files.schema["doc"], StructField("word", StringType()), StructField("lines", LongType())]))


def best_files(files: DataFrame, wanted: DataFrame, k: int, line: float, named: float, part: float) -> tuple[DataFrame, Broadcast]:
    """files(doc, text, name, path in lower case; again), wanted(query, word, tested) -> query, doc, score, and the broadcast that it reads.

    `line` for each line of the text that holds a word, `named` more for each if the file's name does; `part` for each tested word in the path.
    The k best files of each query in a batch, ties by doc; of files that come again, every one with a score, as their rows are yet to be added up.
    """
    rows = wanted.toArrow().combine_chunks()
    query = rows["query"].combine_chunks().dictionary_encode(null_encoding="encode")
    tested = rows["tested"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    sets = []
    for some in (~tested, tested):
        term = rows["word"].combine_chunks().filter(pa.array(some)).dictionary_encode()
        asked = query.indices.to_numpy()[some]
        sets.append((term.dictionary.to_pylist(), blocks.Weights(term.indices.to_numpy(), asked, np.ones(len(asked)), len(term.dictionary), len(query.dictionary))))
    shared = files.sparkSession.sparkContext.broadcast((sets, query.dictionary))
    out = StructType([wanted.schema["query"], files.schema["doc"], StructField("score", DoubleType())])
    most = max(k, blocks.SCORES // max(1, len(query.dictionary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ((words, by_word), (parts, by_part)), queries = shared.value
        held, paths = Words(words), Pieces({p: i for i, p in enumerate(parts)})
        for whole in batches:
            for batch in (whole.slice(a, most) for a in range(0, whole.num_rows, most)):
                sums = np.zeros((batch.num_rows, len(queries)))
                doc, word, value, at, piece = [], [], [], [], []
                for i, (text, name, path) in enumerate(zip(*(_texts(batch.column(c)) for c in ("text", "name", "path")), strict=True)):
                    counts = held.lines(text) if text else {}
                    inside = set(held.of_name[name]) if name and counts else ()
                    doc += [i] * len(counts)
                    word += counts.keys()
                    value += [n * (line + named if j in inside else line) for j, n in counts.items()]
                    found = paths[path] if path else ()
                    at += [i] * len(found)
                    piece += found
                by_word.add(sums, np.array(doc, dtype=np.int64), np.array(word, dtype=np.int64), np.array(value, dtype=np.float64))
                by_part.add(sums, np.array(at, dtype=np.int64), np.array(piece, dtype=np.int64), np.full(len(at), part))
                again = batch.column("again").to_numpy(zero_copy_only=False).astype(bool)
                keep = sums > 0
                r, q = np.nonzero(keep & again[:, None])
                yield _rows(queries, batch.column("doc"), q, r, sums)
                keep &= ~again[:, None]
                if batch.num_rows > k:
                    once = np.where(keep, sums, 0.0)
                    keep &= sums >= np.partition(once, batch.num_rows - k, axis=0)[batch.num_rows - k]
                r, q = np.nonzero(keep)
                kept = blocks.best(q, sums[r, q], blocks.places(batch.column("doc"))[r], k)
                yield _rows(queries, batch.column("doc"), q[kept], r[kept], sums)

    return files.select("doc", "text", "name", "path", "again").mapInArrow(run, out), shared


def _rows(queries: pa.Array, docs: pa.Array, query: np.ndarray, row: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([queries.take(pa.array(query)), docs.take(pa.array(row)), pa.array(sums[row, query])], ["query", "doc", "score"])
