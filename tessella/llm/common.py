"""Shared pieces: scratch tables in the cluster's shared folder, Arrow text blocks, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text is handled in blocks of about this many bytes, whatever the Arrow batch holds.
BLOCK_BYTES = 1 << 20

_U64 = np.uint64
_MIX1, _MIX2 = _U64(0xFF51AFD7ED558CCD), _U64(0xC4CEB9FE1A85EC53)
_S33 = _U64(33)


#: Bytes of one Arrow batch: a task holds few of them, in Spark and in Python.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets the session's Arrow batches hold at most BATCH_BYTES; a smaller size that is set stays."""
    own = spark.conf.get(_BATCH).removesuffix("b")
    if not own.isdigit() or not 0 < int(own) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def trimmed(apply):
    """apply, which gives the memory that it has freed back to the system when a task ends."""

    @wraps(apply)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from apply(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


class Scratch:
    """Tables written to the shared folder and read back, which cuts lineage.

    The folder is ``spark.checkpoint.dir``; only where that is unset and the master is
    local (tests on one machine) a temporary folder is used.  Lost executors recompute
    nothing behind such a table.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        small_batches(spark)
        base = base or f"file://{tempfile.gettempdir()}/scratch-tables"
        self.spark, self.root = spark, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, *, free: bool = False, packed: bool = False) -> DataFrame:
        """Writes df and reads it again; free lets Spark delete the shuffle files behind it, which nothing reads any more.

        Hashes don't shrink, so only tables of texts are packed (compressed).
        """
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "snappy" if packed else "none").parquet(path)
        if free:
            self.spark._jvm.System.gc()  # a shuffle's files go when the driver has collected the plan that made them
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """A column's name as an expression takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def free_name(docs: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be no column of docs (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_rows(docs: DataFrame, apply, more: tuple[StructField, ...] = ()) -> DataFrame:
    """mapInArrow over all columns of docs, whatever their names; apply may append the columns more."""
    small_batches(docs.sparkSession)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(apply, StructType([*plain.schema.fields, *more])).toDF(*docs.columns, *[f.name for f in more])


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 arrays."""
    h = h ^ (h >> _S33)
    h = h * _MIX1
    h ^= h >> _S33
    h *= _MIX2
    h ^= h >> _S33
    return h


def _random_table(seed: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(seed))


_BYTE_VALUE = _random_table(11, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


_POWERS = np.ones(1, dtype=_U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 4096), _U64(_BASE), dtype=_U64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=_U64)
    return _POWERS


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (null rows are empty)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:
        return utf8_column(column.fill_null(""))
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def utf8_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about block_bytes; a longer row is a run of its own."""
    raw, offsets = utf8_column(column)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + block_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every row: A-Z lower-cased, split on ASCII white space.

    Returns (hashes, indptr, start byte, end byte); row i has words indptr[i]:indptr[i+1].
    """
    rows = len(offsets) - 1
    if not len(raw):
        e = np.zeros(0, np.int64)
        return np.zeros(0, _U64), np.zeros(rows + 1, np.int64), e, e
    inside = ~_IS_SPACE[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    indptr = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, _U64), indptr, starts, ends
    lens = ends - starts
    total = int(lens.sum())
    at = np.cumsum(lens) - lens
    place = np.arange(total) - np.repeat(at, lens)
    value = _BYTE_VALUE[_LOWER[raw[np.repeat(starts, lens) + place]]]
    value *= _powers(int(lens.max()))[place]
    return mix64(np.add.reduceat(value, at) + lens.astype(_U64)), indptr, starts, ends


_STEP = [_U64(x) for x in _random_table(23, 64)]


def combine(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words (order matters)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U64)
    h = words[:m] * (_STEP[0] | _U64(1))
    for k in range(1, n):
        h += words[k : k + m] * (_STEP[k] | _U64(1))
    return mix64(h + _U64(n))


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of words."""
    h = _U64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            h = mix64(np.array([h * _STEP[1] + w], dtype=_U64))[0]
    return h


def column_or_null(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def summed_table(partials: DataFrame, slots: int, width: int, *, fan_in: int = 64) -> np.ndarray:
    """Adds up per-task tables on the executors and returns the total: slots * width uint32 counts.

    partials has rows (part int, slot int, counts binary).  Each level brings the tables of
    fan_in tasks to one, in streaming, until one table is left, so a task and the driver
    hold one table each.
    """

    def together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a.astype(np.uint64) + b, 0xFFFFFFFF).astype(np.uint32)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for key, x in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2), strict=True):
                counts = np.frombuffer(x.as_buffer(), dtype=np.uint32)
                total[key] = together(total[key], counts) if key in total else counts.copy()
        for (p, s), x in total.items():
            yield count_rows(p, s, x)

    tasks = partials.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        partials = partials.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).repartition(tasks, "part").mapInArrow(add, COUNTS)
    out = np.zeros((slots, width), dtype=np.uint32)
    for r in partials.collect():
        out[r["slot"]] = together(out[r["slot"]], np.frombuffer(r["counts"], dtype=np.uint32))
    return out.reshape(-1)


COUNTS = "part int, slot int, counts binary"


def count_rows(part: int, slot: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([slot], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["part", "slot", "counts"])


def count_tables(counts: np.ndarray, part: int, slots: int) -> Iterator[pa.RecordBatch]:
    """The rows that summed_table takes, for one task's table; empty slots are left out."""
    for s, x in enumerate(counts.reshape(slots, -1)):
        if x.any():
            yield count_rows(part, s, x)


#: A table of flags by hash: 2**22 bits in 2**16 words, 1 MB whatever the input.
FLAGS = 1 << 22


def _flag_word(key: str) -> Column:
    return F.shiftright(F.col(key).bitwiseAND(FLAGS - 1), 6).cast("int")


def _flag_bit(key: str) -> Column:
    return F.col(key).bitwiseAND(63).cast("int")


def split_by_flags(rows: DataFrame, wanted: DataFrame, key: str, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in wanted, rows whose key is not), by a table of flags of fixed size.

    Only the first need to be shuffled to be joined with wanted.  When the flags fill up,
    the second part runs empty and all is as without them.  The flags are broadcast: at most
    2**16 rows of a word number and 64 flags.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _flag_bit(key))
    flags = wanted.select(_flag_word(key).alias("__word"), bit.alias("__flag")).groupBy("__word").agg(F.bit_or("__flag").alias("__flags"))
    flags = F.broadcast(scratch.keep(flags, name))
    both = rows.withColumn("__at", _flag_word(key)).join(flags, F.col("__at") == F.col("__word"), "left")
    hit = F.coalesce(F.getbit(F.col("__flags"), _flag_bit(key)) == 1, F.lit(False))
    own = lambda where: both.where(where).drop("__at", "__word", "__flags")
    return own(hit), own(~hit)
