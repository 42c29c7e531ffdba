"""The activity clock: idle gaps and debounced changes, as batch and as stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def idle_gaps(events: DataFrame, seconds: int) -> DataFrame:
    """Runs of activity (key, ts) of each key, cut where nothing happened for at least so many seconds."""
    order = Window.partitionBy("key").orderBy("ts")
    before = F.lag("ts").over(order)
    starts = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp")) >= seconds * 1_000_000, F.lit(True))
    runs = events.withColumn("starts", starts).withColumn("run", F.sum(F.col("starts").cast("long")).over(order))
    return runs.groupBy("key", "run").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))


def debounced(events: DataFrame, seconds: float) -> DataFrame:
    """Events (key, ts, value) that nothing of their key follows within the time: the latest of a burst."""
    after = F.lead("ts").over(Window.partitionBy("key").orderBy("ts"))
    quiet = F.coalesce(F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) >= int(seconds * 1e6), F.lit(True))
    return events.withColumn("quiet", quiet).where("quiet").drop("quiet")


def stream_bursts(events: DataFrame, *, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """The stream form of debounced(): one row for each burst of a key, when the watermark has passed it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value")).select("key", "ts", "value")
