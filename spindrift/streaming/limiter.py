"""A limiter of requests as a stateful stream: who may go when, by requests and tokens a minute."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: The limits of a client by default, and the span of time that they hold for.
REQUESTS, TOKENS, SPAN_MS = 60, 150_000, 60_000
#: A waiting request's columns, in the order by which they go; rows that a client gives out at a time.
WAITS, OUT_ROWS = ("arrival", "id", "tokens", "came"), 100_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def admit(went: deque[tuple[int, int]], last: int, arrival: int, tokens: int, requests: int = REQUESTS, limit: int = TOKENS, span: int = SPAN_MS) -> int:
    """When a request may go: not before it came nor before the one ahead of it, and when the requests that went less than `span` before,
    with it, are at most `requests` and have `limit` tokens at most.  One of more tokens than that goes alone.

    went: time and tokens of those that may still count; the request is added and what no longer counts is taken off.
    """
    at = max(arrival, last)
    held = sum(n for _, n in went)
    while went and (len(went) >= requests or held + tokens > limit or went[0][0] + span <= at):
        time, n = went.popleft()
        at, held = max(at, time + span), held - n
    went.append((at, tokens))
    return at


class Limiter(StatefulProcessor):
    """State of a client: requests that wait for the watermark, those that went in the last minute, the time of the last one.

    A request waits until the watermark has passed its arrival, so that requests go in the order of arrival however they came
    in.  A client has one timer, at its first waiting request's arrival: when it is due all go that can, so what waits is read once for a
    batch, not once for each arrival.  One that came too late for that isn't dropped: it arrives at the watermark.
    """

    def __init__(self, requests: int = REQUESTS, tokens: int = TOKENS, span: int = SPAN_MS):
        self.limits = (requests, tokens, span)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField(c, LongType()) for c in WAITS]))
        self.went = handle.getListState("went", StructType([StructField(c, LongType()) for c in ("at", "tokens")]))

    def wake(self, at: int, now: int) -> None:
        """The client's timer is at `at`, unless it has an earlier one; those up to now are due in this batch and go by themselves."""
        timers = [t for t in self.handle.listTimers() if t > now]
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, first = timerValues.getCurrentWatermarkInMs(), None
        for part in rows:
            new = [(max(a, now), i, n, a) for i, a, n in zip(part["id"].tolist(), part["arrival"].tolist(), part["tokens"].tolist(), strict=True)]
            self.waiting.appendList(new)
            least = min(new)[0]
            first = least if first is None else min(first, least)
        if first is not None:
            self.wake(first + 1, now)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = np.fromiter((tuple(r) for r in self.waiting.get()), dtype=[(c, np.int64) for c in WAITS])
        go, stay = rows[rows["arrival"] < now], rows[rows["arrival"] >= now]
        if stay.size:
            self.waiting.put(stay.tolist())
            self.wake(int(stay["arrival"].min()) + 1, now)
        else:
            self.waiting.clear()
        if not go.size:
            return
        go = go[np.lexsort([go[c] for c in reversed(WAITS)])]
        went = deque(tuple(r) for r in self.went.get())
        last = went[-1][0] if went else 0
        for start in range(0, go.size, OUT_ROWS):
            some, at = go[start : start + OUT_ROWS], []
            for arrival, tokens in zip(some["arrival"].tolist(), some["tokens"].tolist(), strict=True):
                last = admit(went, last, arrival, tokens, *self.limits)
                at.append(last)
            yield pd.DataFrame({"client": [key[0]] * some.size, "id": some["id"], "arrival": some["came"], "tokens": some["tokens"], "admitted": at, "delay": np.array(at) - some["came"]})
        self.went.put(list(went))


OUT = StructType([StructField("client", StringType()), *(StructField(c, LongType()) for c in ("id", "arrival", "tokens", "admitted", "delay"))])


def limit(stream: DataFrame, delay: str = "2 minutes", requests: int = REQUESTS, tokens: int = TOKENS, span: int = SPAN_MS) -> DataFrame:
    """stream(client, id, arrival in ms, tokens) -> client, id, arrival, tokens, admitted, delay, in ms.

    A client's requests are one task's, as each waits for those ahead; its state is what waits and a minute's requests.  Null tokens
    count as 0, a null client is one client, rows without arrival or id are left out.  Timers are in event time; the watermark's
    column isn't passed on, so late rows reach the limiter.
    """
    timed = stream.where("arrival is not null and id is not null").withColumn("_at", F.timestamp_millis("arrival")).withWatermark("_at", delay)
    rows = timed.select(F.col("client").cast("string").alias("client"), F.col("id").cast("long").alias("id"), F.col("arrival").cast("long").alias("arrival"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    return rows.groupBy("client").transformWithStateInPandas(Limiter(requests, tokens, span), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def run_limited(out: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append what may go to a Parquet table; the state store that timers need is set for this stream only."""
    conf, key = out.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, STORE)
    try:
        return out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
    finally:
        conf.set(key, before) if before else conf.unset(key)
