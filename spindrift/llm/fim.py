"""Fill-in-middle examples: cuts at units of a text, found by its runs of character classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.words import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass
class Runs:
    """The maximal runs of one character class of a text.  Run r begins at byte start[r]; units[r] units end before it; ends[r]: whether
    each of its characters ends a unit (the class of line feeds) or none does."""

    size: int
    start: np.ndarray
    units: np.ndarray
    ends: np.ndarray
    count: int

    @staticmethod
    def of(text: bytes) -> Runs:
        """Units are lines: up to a line feed, which is theirs, or the text's end."""
        feed = np.frombuffer(text, np.uint8) == 10
        if not len(feed):
            return Runs(0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), 0)
        start = np.concatenate([[0], np.flatnonzero(feed[1:] != feed[:-1]) + 1])
        ends = feed[start]
        length = np.diff(np.append(start, len(feed)))
        units = np.concatenate([[0], np.cumsum(np.where(ends, length, 0))])
        return Runs(len(feed), start, units[:-1], ends, int(units[-1]) + int(not ends[-1]))

    def cut(self, k: int) -> int:
        """The byte after k units: in the last run before which fewer have ended, as far into it as units are missing."""
        if k >= self.count:
            return self.size
        if k <= 0:
            return 0
        r = int(np.searchsorted(self.units, k, side="left")) - 1
        return int(self.start[r]) + k - int(self.units[r])


def _chars(text: bytes) -> int:
    return len(text.decode("utf-8", "replace")) if not text.isascii() else len(text)


def transform(docs: DataFrame, first: Column, second: Column, form: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars, output of each row of docs.

    first, second: numbers that modulo n + 1 are the units after which to cut, in either order; form: 'plain', 'psm' or 'spm', or null for plain.
    psm: prefix, suffix, middle; spm: suffix, prefix, middle, each behind its mark.  A text that is empty or holds a mark stays
    plain: it is its own output, and its two lengths are null.  restore() gives the text back.

    A text is one row's work, whatever its length; nothing is shuffled.  Null texts are empty, n is then 0; null numbers count as 0; repeated
    rows give one result each; other columns of docs aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(first, F.lit(0)).cast("long").alias("first"), F.coalesce(second, F.lit(0)).cast("long").alias("second"), F.coalesce(form, F.lit("plain")).alias("form"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def one(text: bytes, a: int, b: int, form: str) -> tuple:
        runs = Runs.of(text)
        if form == "plain" or not text or any(m in text for m in marks):
            return runs.count, "plain", None, None, text
        lo, hi = sorted((a % (runs.count + 1), b % (runs.count + 1)))
        i, j = runs.cut(lo), runs.cut(hi)
        p, s, m = marks[0] + text[:i], marks[1] + text[j:], marks[2] + text[i:j]
        return runs.count, form, _chars(text[:i]), _chars(text[i:j]), (p + s if form == "psm" else s + p) + m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            asked = zip(*(part.column(c).to_pylist() for c in ("text", "first", "second", "form")), strict=True)
            made = [one(t or b"", a, b, f) for t, a, b, f in asked]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([m[c] for m in made], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output: no mark is in it, so each part ends where the next mark first stands."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
