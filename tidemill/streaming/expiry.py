"""Sessions with a time to live: each ends when nothing of it has come for so long, is reported once, and its state goes.

State is keyed and kept by Spark; a timer in event time ends a session when the watermark passes it. The session's stateStore must be the
one on RocksDB (set by `ended_sessions`), which keeps more than memory holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """Keeps first and last time and the number of events of each session."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first bigint, last bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, n = self.seen.get() if self.seen.exists() else (None, None, 0)
        ends = None if last is None else last + self.millis
        for frame in rows:
            at = frame["millis"]
            first, last, n = min(x for x in (first, int(at.min())) if x is not None), max(x for x in (last, int(at.max())) if x is not None), n + len(at)
        self.seen.update((first, last, n))
        if ends is not None and ends != last + self.millis:
            self.handle.deleteTimer(ends)
        self.handle.registerTimer(last + self.millis)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, n = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"key": [str(key[0])], "first": [first], "last": [last], "n": [n]})

    def close(self) -> None:
        pass


def ended_sessions(stream: DataFrame, key: str, ts: str, seconds: int, late: str = "0 seconds") -> DataFrame:
    """A stream of (key, first_used, last_used, n): sessions of which nothing came for so many seconds of event time.

    A session is open until the watermark, `late` behind the newest event, passes its last event by as much; what comes before that belongs to
    it, as in a store that forgets, and what comes after begins a new one of the same key. Events behind the watermark are dropped, and
    those without a key or time. The end shows with the first batch after the watermark has passed it.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    kind = stream.schema[key].dataType
    timed = stream.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(ts).cast("timestamp").alias("_ts")).where("_ts is not null")
    timed = timed.withWatermark("_ts", late).withColumn("millis", F.unix_millis("_ts"))
    out = timed.groupBy("_key").transformWithStateInPandas(Sessions(seconds * 1000), "key string, first bigint, last bigint, n bigint", "Append", "EventTime")
    return out.select(F.col("key").cast(kind).alias(key), F.timestamp_millis("first").alias("first_used"), F.timestamp_millis("last").alias("last_used"), "n")
