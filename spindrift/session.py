"""Sessions and what workers need."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
_SENT: set[str] = set()


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package: those of one machine from its folder, those of a cluster from a zip that Spark sends."""
    context = spark.sparkContext
    env = context.environment
    have = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in have:
        env["PYTHONPATH"] = ":".join([ROOT, *have])
    if context.applicationId not in _SENT and context.master != "local" and not context.master.startswith("local["):
        _SENT.add(context.applicationId)
        context.addPyFile(packed(tempfile.mkdtemp(prefix="package-")))


def packed(folder: str) -> str:
    """A zip of the package's modules and texts, on the driver's disk."""
    path = f"{folder}/spindrift.zip"
    package = Path(ROOT) / "spindrift"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*")):
            if f.suffix in (".py", ".txt"):
                z.write(f, f.relative_to(ROOT))
    return path


def build(app: str = "spindrift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC, and skew handling; other settings as keyword arguments with _ for dots."""
    b = SparkSession.builder.appName(app)
    b = b.master(master) if master else b
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (own | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
