"""Tables written to the shared folder: they end a plan's lineage and can be read by any executor."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset a folder of this process is used if driver and workers are one machine (local[n], tests); a cluster
    without the setting is refused, as a machine's own folder isn't seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


#: Folder name of a table in the shared folder -> the paths that go when a result that reads it is released.  Only tables that were
#: tied to a result are here: a table that a caller cut for several results stays until it is released itself.
_TIED: dict[str, set[str]] = {}


def fresh(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, for tables and streams that adopt() then ties to a result."""
    return f"{scratch(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder (or at a path) and read it again.  release() removes it."""
    spark = df.sparkSession
    path = at or fresh(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cuts = [path]
    return out


def _name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def _read(df: DataFrame) -> set[str]:
    """Names of the shared folder's tables that a lazy result reads, whatever was done to it since: by the roots of its plan's leaves, not by files."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = set()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            continue
        roots = leaf.relation().location().rootPaths()
        matches = (re.search(r"/([a-z]+-[0-9a-f]{32})(?:/|$)", roots.apply(i).toString()) for i in range(roots.size()))
        found.update(m[1] for m in matches if m)
    return found


def reading(out: DataFrame, *tables: DataFrame) -> DataFrame:
    """out, a lazy result that reads tables of cut(): release() of it, or of what is made of it, removes them once it is used."""
    return adopt(out, *(p for t in tables for p in getattr(t, "_cuts", [])))


def adopt(out: DataFrame, *paths: str) -> DataFrame:
    """out, with these paths, some of which it reads, to be removed when it, or what is made of it, is released."""
    read = _read(out)
    every = {*paths, *(q for n in read for q in _TIED.get(n, ()))}
    for name in {_name(p) for p in every} & read:
        _TIED.setdefault(name, set()).update(every)
    out._cuts = list(every)
    return out


def filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def release(*tables: DataFrame) -> None:
    """Remove the tables of cut() that these are, or that were tied to them: nothing lazy may read them any more."""
    for t in tables:
        paths = set(getattr(t, "_cuts", []))
        for name in {_name(p) for p in paths} or _read(t):
            paths |= _TIED.pop(name, set())
        for path in paths:
            fs, p = filesystem(t.sparkSession, path)
            fs.delete(p, True)
            _TIED.pop(_name(path), None)
