"""Streaming forms: checkpointed append, running counts, sliding rate sums.  The same functions run on batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def running_counts(events: DataFrame, by: str = "event_type", value: str = "value") -> DataFrame:
    return events.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def sliding_totals(events: DataFrame, ts: str = "ts", value: str = "value", width: str = "60 seconds", slide: str = "30 seconds", late: str = "2 minutes") -> DataFrame:
    """Requests and tokens of sliding windows; on a stream, rows later than the watermark are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if events.isStreaming else timed
    w = timed.groupBy(F.window("_ts", width, slide).alias("w")).agg(F.count("*").alias("requests"), F.round(F.sum(value), 4).alias("tokens"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "tokens")


def append_checkpointed(stream: DataFrame, path: str, checkpoint: str, by: str | None = None) -> StreamingQuery:
    """Append to a Parquet table; a restart goes on after the last committed batch."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.partitionBy(by) if by else writer).start(path)


def checkpoint_every(stream: DataFrame, path: str, checkpoint: str, rows: int = 5, by: str = "instance_id") -> StreamingQuery:
    """Append with a marker of progress: a batch's rows are written with its number, in files of at most `rows` rows; a batch that
    runs again after a failure replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions(by).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(lambda b, n: write(b.drop("batch") if "batch" in b.columns else b, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def update_table(stream: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()


def fold_table(stream: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Append what a watermark has closed to a Parquet table; what is still open at the end isn't in it."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
