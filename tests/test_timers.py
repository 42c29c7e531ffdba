"""Streams whose output waits for the clock, not for later events."""

import time

import pytest
from pyspark.sql import functions as F

from tessella.streaming import timers

SCHEMA = "key string, ts timestamp, value string, kind string, number long, work string"


class Live:
    """A stream over a folder that the test adds files to."""

    def __init__(self, spark, path, make, name):
        self.spark, self.path, self.name, self.count = spark, path, name, 0
        (path / "in").mkdir(exist_ok=True)
        timers.with_timers(spark)
        stream = spark.readStream.schema(SCHEMA).parquet(str(path / "in"))
        self.query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(path / "c")).outputMode("append").trigger(processingTime="200 milliseconds").start()

    def add(self, *rows):
        self.count += 1
        frame = self.spark.createDataFrame([tuple(r.get(c.split()[0]) for c in SCHEMA.split(", ")) for r in rows], SCHEMA.replace("ts timestamp", "ts string"))
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(self.path / f"out{self.count}"))
        for f in (self.path / f"out{self.count}").glob("part-*.parquet"):
            f.rename(self.path / "in" / f"{self.name}-{self.count}.parquet")

    def rows(self, *columns):
        return sorted(tuple(r) for r in self.spark.table(self.name).select(*columns).collect())

    def wait(self, want, *columns, most=60):
        end = time.time() + most
        while time.time() < end and self.rows(*columns) != want:
            assert self.query.exception() is None, self.query.exception()
            time.sleep(0.3)
        assert self.rows(*columns) == want


@pytest.fixture
def live(spark, tmp_path):
    begun = []

    def start(make, name):
        begun.append(Live(spark, tmp_path, make, name))
        return begun[-1]

    yield start
    for x in begun:
        x.query.stop()


def test_a_burst_ends_by_silence_alone(live):
    own = live(lambda s: timers.bursts(s, seconds=4), "silent_bursts")
    at = lambda key, second, value: {"key": key, "ts": f"2024-01-01 00:00:{second:02d}", "value": value}
    own.add(at("a", 1, "one"), at("a", 3, "three"), at("a", 2, "two"), at("b", 1, "only"), {"key": None, "ts": "2024-01-01 00:00:00"})
    own.wait([("a", "three"), ("b", "only")], "key", "value")
    own.add(at("a", 9, "again"))
    own.wait([("a", "again"), ("a", "three"), ("b", "only")], "key", "value")
    state = own.query.lastProgress["stateOperators"][0]
    end = time.time() + 20
    while state["numRowsTotal"] and time.time() < end:
        time.sleep(0.5)
        state = own.query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 0  # neither values nor timers are left


def test_work_waits_until_its_key_is_idle(live):
    own = live(lambda s: timers.when_idle(s, seconds=4), "idle_work")
    mark = lambda key: {"key": key, "kind": "mark"}
    work = lambda key, n: {"key": key, "kind": "work", "number": n, "work": f"do {n}"}
    own.add(mark("a"), work("a", 2), work("a", 1), work("b", 7), work("a", 2))
    own.wait([("a", 1, "do 1"), ("a", 2, "do 2"), ("b", 7, "do 7")], "key", "number", "work")
    own.add(mark("a"))
    time.sleep(6)
    own.add(work("a", 3))
    own.wait([("a", 1), ("a", 2), ("a", 3), ("b", 7)], "key", "number")


def test_a_restart_keeps_open_bursts(live):
    own = live(lambda s: timers.bursts(s, seconds=10), "before_restart")
    own.add({"key": "a", "ts": "2024-01-01 00:00:01", "value": "kept"})
    end = time.time() + 40
    while not any(p["numInputRows"] for p in own.query.recentProgress) and time.time() < end:
        time.sleep(0.1)
    own.query.stop()
    assert own.rows("key") == []
    own.spark.sql("DROP VIEW IF EXISTS after_restart")
    stream = own.spark.readStream.schema(SCHEMA).parquet(str(own.path / "in"))
    got = []
    query = timers.bursts(stream, seconds=10).writeStream.foreachBatch(lambda rows, _: got.extend(rows.collect())).option("checkpointLocation", str(own.path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        own.add({"key": "z", "ts": "2024-01-01 00:00:02", "value": "new"})  # Spark runs no batch after a restart before something comes
        end = time.time() + 60
        while time.time() < end and len(got) < 2:
            time.sleep(0.5)
        assert sorted((r["key"], r["value"]) for r in got) == [("a", "kept"), ("z", "new")]
    finally:
        query.stop()
