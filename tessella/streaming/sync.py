"""File changes as micro-batches: each batch is diffed against the manifest and merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental
from ..operators.snapshots import diff, scoped, upsert
from ..sources.shared import Tables
from ..sources.snapshots import SnapshotStore


def apply_batch(batch: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, new manifest) for a batch (file, hash, at) of file events; a null hash is a removal, the latest event of a file counts."""
    last = batch.groupBy("file").agg(F.max_by("hash", "at").alias("hash"))
    there = last.where("hash IS NOT NULL")
    current = upsert(manifest.select("file", "hash"), there, "file").join(last.where("hash IS NULL"), "file", "left_anti")
    return scoped(diff(current, manifest), last), current


def start(events: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame], None], *, checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    """Runs apply_batch on a stream of file events; write gets the changes and the new manifest.  A batch that fails is tried again."""

    def batch(rows: DataFrame, _: int) -> None:
        write(*apply_batch(rows, read()))

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(batch).start()


def sync_store(store: SnapshotStore, batch: DataFrame, *, stream: str, number: int, digest: incremental.Digest = incremental.without_summaries) -> int:
    """Brings a stored graph up to date with a batch (file, content, at) and returns the version that holds it.

    A null content is a removal; of a file's rows the latest counts.  The batch's number is noted
    with the version, so that a batch of the same stream that comes again changes nothing.
    """
    base = store.latest()
    note = {} if base is None else store.note(base)
    if base is not None and note.get(stream, -1) >= number:
        return base
    with Tables(batch.sparkSession, "stream-sync") as tables:
        last = tables.keep(batch.groupBy("file").agg(F.max_by(F.struct("content"), "at").alias("r")).select("file", "r.content"))
        there = last.where("content IS NOT NULL").withColumn("hash", F.sha1(F.col("content").cast("binary")))
        held = store.tables(base)
        if all(t in held for t in incremental.CodeGraph.TABLES):
            graph = incremental.CodeGraph(**{t: held[t] for t in incremental.CodeGraph.TABLES})
        else:
            graph = incremental.build(there.limit(0), digest=digest, tables=tables)
        others = graph.manifest.join(last.select("file"), "file", "left_anti").select("file", F.lit(None).cast("string").alias("content"), "hash")
        synced = incremental.sync(graph, others.unionByName(there), scope=last.select("file"), digest=digest, tables=tables)
        return store.commit(synced.graph.tables(), base=base, note=note | {stream: number})


def start_graph(files: DataFrame, store: SnapshotStore, *, checkpoint: str, every: str | None = "2 seconds", digest: incremental.Digest = incremental.without_summaries, attempts: int = 2) -> StreamingQuery:
    """Keeps a stored graph up to date with a stream of file contents (file, content, at).

    A batch that fails `attempts` times is noted in the store's table errors (stream, batch, error)
    and passed over; the graph stays as it was before it, and the stream goes on.  Without
    `every` the stream ends when it has seen what is there.
    """
    spark = files.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            for left in reversed(range(attempts)):
                try:
                    sync_store(store, rows, stream=checkpoint, number=number, digest=digest)
                    return
                except Exception as e:  # noqa: BLE001  whatever the batch holds, the stream goes on
                    if not left:
                        failed(number, f"{type(e).__name__}: {str(e)[:500]}")
        finally:
            rows.unpersist()

    def failed(number: int, error: str) -> None:
        base = store.latest()
        row = spark.createDataFrame([(checkpoint, number, error)], "stream string, batch long, error string")
        known = store.tables(base).get("errors")
        note = {} if base is None else store.note(base)
        store.commit({"errors": row if known is None else known.unionByName(row)}, base=base, note=note | {checkpoint: number})

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(batch).start()
