"""Prediction files as a data source of their own: read at once in byte ranges, or followed as they grow.

spark.dataSource.register(Predictions); spark.read.format("predictions").load(path); spark.readStream.format("predictions").load(path).
Spark's own file stream takes each file once and whole; a run appends its predictions to one file, so here an offset is what has been
read of each file, and a line counts once its end has been written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: file, at: where a row's line begins, so that the last of repeated ids can be told.
SCHEMA = "instance_id string, model_patch string, model_name_or_path string, file string, at long"
RANGE_BYTES = 64 << 20
BLOCK = 1 << 20


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at bytes start to stop - 1."""

    path: str
    start: int
    stop: int


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))


def sizes(path: str) -> dict[str, int]:
    """Bytes of each .jsonl file at or below a path, by name; marks and hidden files aside."""
    from pyarrow import fs

    system, root = _filesystem(path)
    found = system.get_file_info(root)
    files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in files if f.type == fs.FileType.File and f.base_name.endswith((".jsonl", ".json")) and f.base_name[0] not in "_."}


def lines(system, name: str, start: int, stop: int, whole: bool) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the range.  whole: the file won't grow, so a last line without an end counts."""
    with system.open_input_file(name) as f:
        size = f.size()
        at = start
        if start > 0:  # the line that began before is another range's
            f.seek(start - 1)
            at = start - 1
        rest, skip = b"", start > 0
        while True:
            block = f.read(BLOCK)
            if not block:
                break
            rest += block
            *complete, rest = rest.split(b"\n")
            for line in complete:
                if skip:
                    skip = False
                elif at >= stop:
                    return
                else:
                    yield at, line
                at += len(line) + 1
            if not skip and at >= stop:
                return
        if whole and rest and not skip and at < stop and at < size:
            yield at, rest


def parsed(name: str, found: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
    """Rows of the lines that are JSON objects; others, and fields of another kind, are left out."""
    for at, line in found:
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict):
            text = lambda k, row=row: v if isinstance(v := row.get(k), str) else None if v is None or isinstance(v, dict | list) else json.dumps(v)
            yield text("instance_id"), text("model_patch"), text("model_name_or_path"), name, at


def ranges(path: str, before: dict[str, int], until: dict[str, int], most: int) -> list[Range]:
    out = []
    for name in sorted(until):
        at = before.get(name, 0)
        while at < until[name]:
            end = min(at + most, until[name])
            out.append(Range(name, at, end))
            at = end
    return out


class Batch(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Range]:
        return ranges(self.path, {}, sizes(self.path), self.most) or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.path:
            yield from parsed(part.path, lines(_filesystem(self.path)[0], part.path, part.start, part.stop, True))


class Follow(DataSourceStreamReader):
    """Offsets: for each file the end of its last whole line."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = _filesystem(self.path)
        now = {}
        for name, size in sizes(self.path).items():
            known = self.seen.get(name, 0)
            now[name] = known if size <= known else self._whole(system, name, known, size)
        self.seen = now
        return {k: v for k, v in now.items() if v}

    def _whole(self, system, name: str, start: int, size: int) -> int:
        """The end of the last line that ends before size, or start: looked for from behind, block by block."""
        with system.open_input_file(name) as f:
            stop = size
            while stop > start:
                low = max(start, stop - BLOCK)
                f.seek(low)
                found = f.read(stop - low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                stop = low
        return start

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(self.path, start, end, self.most) or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.path:
            yield from parsed(part.path, lines(_filesystem(self.path)[0], part.path, part.start, part.stop, False))

    def commit(self, end: dict) -> None:
        pass


class Predictions(DataSource):
    """Options: path, a file or a folder that driver and workers reach (local or shared, or what pyarrow opens); rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "predictions"

    def schema(self) -> str:
        return SCHEMA

    def _most(self) -> int:
        return max(1, int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))

    def reader(self, schema: StructType) -> Batch:
        return Batch(self.options["path"], self._most())

    def streamReader(self, schema: StructType) -> Follow:
        return Follow(self.options["path"], self._most())
