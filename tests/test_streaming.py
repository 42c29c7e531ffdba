"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from tessella.operators import turns
from tessella.sources.tables import messages
from tessella.streaming import clock, fold, sync

SF = "/root/testdata/sf0.001"


def run(stream, name, spark, path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(path)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_fold_equals_batch(spark, tmp_path):
    rows = messages(spark, SF)
    size = rows.agg(F.max("seq")).first()[0] + 1
    for k in range(3):
        lo, hi = size * k // 3, size * (k + 1) // 3
        rows.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for n in (0, 1, 2):
        changes = run(fold.fold_stream(stream, n), f"fold{n}", spark, tmp_path / f"c{n}")
        got = fold.current(changes).select("session", "kind", "turn", "seq", "text").collect()
        marked = turns.segment(rows)
        body = turns.recency(marked, n).select("session", "kind", "turn", "seq", "text")
        pinned = marked.where("bucket = 'pinned'").select("session", F.lit("pinned").alias("kind"), F.lit(None).cast("long").alias("turn"), "seq", "text")
        assert sorted(map(str, got)) == sorted(map(str, body.unionAll(pinned).collect()))


def test_bursts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1), (1, "2024-01-01 00:00:01", 2), (1, "2024-01-01 00:00:05", 3), (2, "2024-01-01 00:00:00", 4), (9, "2024-01-02 00:00:00", 9)], "key long, ts string, value long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r["key"], r["value"]) for r in clock.debounced(rows, 2).collect()} == {(1, 2), (1, 3), (2, 4), (9, 9)}
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = run(clock.stream_bursts(stream), "bursts", spark, tmp_path / "c")
    assert {(r["key"], r["value"]) for r in got.collect()} == {(1, 2), (1, 3), (2, 4)}  # the last burst is open


def test_sync_batches(spark):
    manifest = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file string, hash string")
    batch = spark.createDataFrame([("a", "2", 1), ("a", "3", 2), ("b", None, 1), ("d", "1", 1), ("c", "1", 1)], "file string, hash string, at long")
    changes, now = sync.apply_batch(batch, manifest)
    assert {tuple(r) for r in changes.collect()} == {("a", "changed"), ("b", "removed"), ("d", "added")}
    assert {tuple(r) for r in now.collect()} == {("a", "3"), ("c", "1"), ("d", "1")}
