"""What the operators of this folder share: scratch tables, text rules, safe names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import tables
from spindrift.session import share_package
from spindrift.tables import filesystem, reading, release, scratch

__all__ = ["Scope", "cut", "filesystem", "literal_table", "lower_ascii", "raw", "reading", "release", "scratch", "slices", "table"]

#: Separators of the contracts' words: space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of text that a worker turns into Python objects at a time.
TEXT_BATCH = 400
_SCOPES: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def slices(batches: Iterable[pa.RecordBatch], rows: int = TEXT_BATCH) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to `rows` rows, so that a worker's memory doesn't depend on the session's batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def raw(col: pa.Array) -> list[bytes | None]:
    """Strings as UTF-8 bytes, whatever they hold."""
    return col.cast(pa.binary()).to_pylist()


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: the lineage ends there,
    and a lost executor costs at most a re-read.  release() or the end of a Scope removes the table."""
    out = tables.cut(df)
    for s in _SCOPES.get():
        s.append(out)
    return out


class Scope:
    """with Scope() as s: ... s.keep(df); at the end all tables that were cut inside go but those kept."""

    def __enter__(self) -> Scope:
        self.made: list[DataFrame] = []
        self.kept: set[str] = set()
        self.token = _SCOPES.set((*_SCOPES.get(), self.made))
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.update(getattr(df, "_cuts", []))
        return df

    def __exit__(self, *_: object) -> None:
        _SCOPES.reset(self.token)
        release(*(t for t in self.made if not self.kept.intersection(t._cuts)))


def literal_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small fixed table made of literals: a JVM-only plan, without a Python RDD."""
    structs = [F.struct(*(F.lit(v).alias(c) for v, c in zip(r, columns, strict=True))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
