"""Sharding by size-tiered compaction (DataFrame functions only).

Arrivals are appended as small immutable shards.  Shards of a similar size, a tier, are merged once
there are enough of them, into files of a target size.  What a reader sees is a manifest: a
numbered file that lists the live shards and appears whole or not at all.
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import filesystem


#: Times that an append tries to commit on top of other writers' versions.
COMMITS = 20


class ShardStore:
    """A table of shards under one folder of a shared file system.

    data/<shard>/ holds Parquet files that never change; manifests/<version>.json lists the shards of a version with their
    tier, bytes and files.  A writer that fails leaves files that no manifest names: readers never see them and
    vacuum() removes them.  Two writers can't commit the same version: a manifest is renamed into place only if there is none, which
    HDFS decides in one step; a store whose rename is a copy needs a catalog of its own for several writers at once.
    An append that comes second is committed on top of the first; a compaction that does is refused.
    """

    def __init__(self, spark: SparkSession, root: str, small_bytes: int = 1 << 20, fanout: int = 4, target_bytes: int = 128 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.small_bytes, self.fanout, self.target_bytes = small_bytes, fanout, target_bytes

    # Manifests

    def versions(self) -> list[int]:
        fs, p = filesystem(self.spark, f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(p))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        have = self.versions()
        version = (have[-1] if have else 0) if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        fs, p = filesystem(self.spark, f"{self.root}/manifests/{version:010d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        """The next version after base, written aside and renamed; raises if another writer took it."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["id"])}
        jvm = self.spark._jvm
        fs, to = filesystem(self.spark, f"{self.root}/manifests/{new['version']:010d}.json")
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, False)
        out.write(json.dumps(new).encode())
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        keep = self.spark.sparkContext._gateway.new_array(kind, 1)
        keep[0] = kind.NONE  # an existing file is not replaced
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, to, keep)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if not fs.exists(to):
                raise
            raise RuntimeError(f"version {new['version']} was committed by another writer") from e
        return new

    # Shards

    def _shard(self, name: str, at: str) -> dict:
        fs, p = filesystem(self.spark, f"{self.root}/{at}")
        sizes = [s.getLen() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
        size = sum(sizes)
        return {"id": name, "path": at, "bytes": size, "files": len(sizes), "tier": self.tier(size)}

    def tier(self, size: int) -> int:
        """0 up to small_bytes, then one more for each factor of fanout."""
        return max(0, math.ceil(math.log(max(1, size) / self.small_bytes, self.fanout)))

    def append(self, df: DataFrame, arrival: str | None = None) -> dict:
        """df's rows as small shards, one for each value of the column `arrival` (one in all if it is not given); they are
        visible once the manifest is there.  An empty df adds a version without new shards."""
        batch = uuid.uuid4().hex[:12]
        at = f"data/{batch}"
        fields = [f for f in df.schema.fields if f.name != arrival]
        schema = type(df.schema)(fields).json()
        self._same_columns(self.manifest(), schema)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(arrival) if arrival else writer).parquet(f"{self.root}/{at}")
        fs, p = filesystem(self.spark, f"{self.root}/{at}")
        if arrival:
            names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
            added = [self._shard(f"{batch}-{n.split('=', 1)[1]}", f"{at}/{n}") for n in sorted(names)]
        else:
            added = [self._shard(batch, at)]
        for left in range(COMMITS - 1, -1, -1):
            base = self.manifest()
            self._same_columns(base, schema)
            try:
                return self.commit(base, base["shards"] + [s for s in added if s["bytes"]], schema)
            except RuntimeError:
                if not left:
                    raise
        raise AssertionError

    @staticmethod
    def _same_columns(base: dict, schema: str) -> None:
        if base["schema"] and json.loads(base["schema"]) != json.loads(schema):
            raise ValueError("the arrival's columns differ from the table's")

    def _load(self, shards: list[dict], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kind))
        # The files' own folders are named, so that a folder's name is never taken for a column.
        return self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(*(f"{self.root}/{s['path']}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the table has no version")
        return self._load(m["shards"], m["schema"])

    def compact(self) -> dict:
        """Merge tiers with at least `fanout` shards until there are none; each round commits one version.

        A merge reads whole shards and writes ceil(bytes / target_bytes) files at most, without a shuffle: tasks read
        neighbouring files, so no key and no shard ends in one task because of its rows.
        """
        now = self.manifest()
        while runs := self._runs(now["shards"]):
            shards = now["shards"]
            for run in runs:
                name = uuid.uuid4().hex[:12]
                files = max(1, math.ceil(sum(s["bytes"] for s in run) / self.target_bytes))
                self._load(run, now["schema"]).coalesce(files).write.option("compression", "zstd").parquet(f"{self.root}/data/{name}")
                gone = {s["id"] for s in run}
                merged = self._shard(name, f"data/{name}")
                merged["tier"] = max(merged["tier"], run[0]["tier"] + 1)
                shards = [s for s in shards if s["id"] not in gone] + [merged]
            now = self.commit(now, shards, now["schema"])
        return now

    def _runs(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of similar shards to merge: all of a tier with `fanout` or more, smallest first.

        Shards whose files are of the target size already, or half of it, gain nothing and are left as they are.
        """
        tiers: dict[int, list[dict]] = {}
        for s in sorted((s for s in shards if 2 * s["bytes"] < self.target_bytes * s["files"]), key=lambda s: (s["bytes"], s["id"])):
            tiers.setdefault(s["tier"], []).append(s)
        return [t for _, t in sorted(tiers.items()) if len(t) >= self.fanout]

    def vacuum(self, versions: int = 1) -> int:
        """Remove shards that none of the newest `versions` manifests names; older versions can't be read afterwards.

        Not while a writer is at work: what it has written isn't in a manifest yet.
        """
        live = {s["path"] for v in self.versions()[-versions:] for s in self.manifest(v)["shards"]}
        fs, p = filesystem(self.spark, f"{self.root}/data")
        gone = 0
        for folder in fs.listStatus(p) if fs.exists(p) else []:
            at = f"data/{folder.getPath().getName()}"
            if at in live:
                continue
            below = [f"{at}/{s.getPath().getName()}" for s in fs.listStatus(folder.getPath()) if s.isDirectory()]
            for x in [b for b in below if b not in live] if any(b in live for b in below) else [at]:
                gone += fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{x}"), True)
        return gone
