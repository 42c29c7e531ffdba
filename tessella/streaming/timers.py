"""Bursts and idle times of keys on the clock: state with processing-time timers.

Where clock.stream_bursts() waits for the watermark, which later events must move, a timer ends a
burst when its silence has passed, whether or not anything follows.  A key's state is cleared when
its timer has fired, so keys that are silent hold none.  Timers belong to the stream's checkpoint:
after a restart those that are overdue fire with the first batch, which Spark runs when something
new comes, of whatever key.  The state store must keep timers
(with_timers() sets it); deliveries that are repeated after a failure change nothing, as a burst
keeps only its latest event and held work is told by its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

#: Seconds of silence that end a burst of file changes, and that let background work go on.
BURST, IDLE = 2.0, 5.0

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    """Sets the state store that timers need, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class _Silence(StatefulProcessor):
    """A timer for each key that every event puts off."""

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def put_off(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.wait)

    def close(self) -> None:
        pass


_LATEST = StructType([StructField("ts", TimestampType()), StructField("value", StringType())])


class _Bursts(_Silence):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.latest = handle.getValueState("latest", _LATEST)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.latest.get()) if self.latest.exists() else None
        for part in rows:
            for ts, value in zip(part["ts"], part["value"], strict=True):
                if best is None or (ts, value) >= (pd.Timestamp(best[0]), best[1]):
                    best = (ts, value)
        self.latest.update(best)
        self.put_off(timerValues.getCurrentProcessingTimeInMs())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists():
            ts, value = self.latest.get()
            self.latest.clear()
            yield pd.DataFrame({"key": [key[0]], "ts": [ts], "value": [value]})


def bursts(events: DataFrame, *, seconds: float = BURST) -> DataFrame:
    """(key, ts, value): the latest event of each burst of a stream (key string, ts timestamp, value string), once nothing of its key has come for so long."""
    out = StructType([StructField("key", StringType()), *_LATEST.fields])
    rows = events.selectExpr("CAST(key AS STRING) AS key", "CAST(ts AS TIMESTAMP) AS ts", "coalesce(CAST(value AS STRING), '') AS value").where("key IS NOT NULL AND ts IS NOT NULL")
    return rows.groupBy("key").transformWithStateInPandas(_Bursts(seconds), out, "Append", "processingTime")


_WORK = StructType([StructField("number", LongType()), StructField("work", StringType())])


class _Gate(_Silence):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getMapState("held", StructType([_WORK[0]]), StructType([_WORK[1]]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active = not list(self.handle.listTimers())  # work alone waits one silence, too: the key may be busy
        for part in rows:
            active = active or bool((part["kind"] == "mark").any())
            for number, work in part.loc[part["kind"] == "work", ["number", "work"]].itertuples(index=False):
                self.held.updateValue((int(number),), (work,))
        if active:
            self.put_off(timerValues.getCurrentProcessingTimeInMs())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = sorted((k[0], v[0]) for k, v in self.held.iterator())
        self.held.clear()
        if rows:
            yield pd.DataFrame({"key": [key[0]] * len(rows), "number": [n for n, _ in rows], "work": [w for _, w in rows]})


def when_idle(events: DataFrame, *, seconds: float = IDLE) -> DataFrame:
    """(key, number, work): work that a stream (key, kind, number, work) has asked for, once its key has been idle for so long.

    Rows of the kind "mark" say that the key is active (a request has begun or ended); rows of the
    kind "work" are held.  Marks put the release off, work doesn't.
    """
    out = StructType([StructField("key", StringType()), *_WORK.fields])
    rows = events.selectExpr("CAST(key AS STRING) AS key", "kind", "CAST(coalesce(number, 0) AS LONG) AS number", "coalesce(work, '') AS work").where("key IS NOT NULL")
    return rows.groupBy("key").transformWithStateInPandas(_Gate(seconds), out, "Append", "processingTime")
