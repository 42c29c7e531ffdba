"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines of a text (split at "\\n") is hashed to 128 bits.  The
first occurrence of a window, by doc_id and then line number, is the one that stays; the
lines of every later occurrence are covered, overlapping cover merges, and covered lines go.
Repeated windows are found by a map-side combined minimum, so a line that half of the
documents share costs one row for each task; the join back to the occurrences is skew-safe.

Defined results: a null text stays null, and a text of fewer than three lines has no window
and stays as it is; a text whose lines all go becomes empty; rows are told apart by doc_id
and text, so repeated rows count as one document and are cut alike; rows with a null doc_id
come last, and texts of one id in the order of a hash; the text's column is replaced in
place and other columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, quoted, split_by_flags

WINDOW = 3


def _windows(text: Column, size: int) -> Column:
    """The hashes (h1, h2) of the windows of a text, in order."""
    lines = F.split(text, "\n")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(97), x).alias("b")))
    whole = F.sequence(F.lit(0), F.size(lines) - size)

    def at(h: Column, k: Column) -> Column:
        parts = [F.get(h, k + j) for j in range(size)]
        return F.struct(F.xxhash64(*[p["a"] for p in parts]).alias("h1"), F.xxhash64(F.lit(13), *[p["b"] for p in parts]).alias("h2"))

    # the hashes are bound once, as the only element of an array
    return F.when(F.size(lines) >= size, F.flatten(F.transform(F.array(hashed), lambda h: F.transform(whole, lambda k: at(h, k)))))


def _text_id(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def covered_lines(docs: DataFrame, scratch: Scratch, *, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(k, tid, starts): for each document with repeats, the line numbers at which windows seen earlier start."""
    rows = docs.select(F.col(key).alias("k"), _text_id(key, text).alias("tid"), _windows(F.col(text), size).alias("w")).where("w is not null")
    cells = scratch.keep(rows.select("k", "tid", F.posexplode("w").alias("pos", "w")).select("k", "tid", "pos", "w.h1", "w.h2"), "windows")
    # a window's least id, the first text of that id, and the first place there
    texts = cells.groupBy("h1", "h2", "k", "tid").agg(F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    ids = texts.groupBy("h1", "h2", "k").agg(F.min("tid").alias("t0"), F.min_by("p0", "tid").alias("p0"), ((F.count("*") > 1) | F.max(F.col("p0") < F.col("p1"))).alias("again"))
    first = ids.groupBy("h1", "h2").agg(
        F.min("k").alias("k0"),
        F.coalesce(F.min_by("t0", "k"), F.min("t0")).alias("t0"),
        F.coalesce(F.min_by("p0", "k"), F.min("p0")).alias("p0"),
        ((F.count("*") > 1) | F.max("again")).alias("again"),
    )
    first = scratch.keep(first.where("again").drop("again"), "repeated", free=True)
    own = F.col("k").eqNullSafe(F.col("k0")) & (F.col("tid") == F.col("t0")) & (F.col("pos") == F.col("p0"))
    later = cells.join(first, ["h1", "h2"]).where(~own)
    starts = scratch.keep(later.groupBy("k", "tid").agg(F.collect_set("pos").alias("starts")), "starts", free=True)
    scratch.drop("windows")
    scratch.drop("repeated")
    return starts


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """docs with later occurrences of line windows cut from the text; the same columns in the same order."""
    return annotate(docs, key=key, text=text, size=size).select(*[F.col(f"r.{quoted(c)}") if c != text else F.col("kept").alias(text) for c in docs.columns])


def annotate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row for each of docs: its columns as struct r, the text that is kept, n_lines and n_removed.

    Only documents that may hold a repeated window are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    starts = covered_lines(docs, scratch, key=key, text=text, size=size)
    rows = docs.select(F.struct("*").alias("r"), F.col(key).alias("k"), _text_id(key, text).alias("tid"))
    some, others = split_by_flags(rows, starts, "tid", scratch, "flags")
    both = some.alias("d").join(starts.alias("s"), (F.col("d.tid") == F.col("s.tid")) & F.col("d.k").eqNullSafe(F.col("s.k")), "left").select("r", "starts")
    both = both.unionAll(others.select("r", F.lit(None).cast(starts.schema["starts"].dataType).alias("starts")))
    own = F.col(f"r.{quoted(text)}")
    lines = F.split(own, "\n")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (size - 1)))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    # the lines are bound once, as the only element of an array
    left = F.flatten(F.transform(F.array(lines), lambda x: F.transform(left, lambda i: F.get(x, i))))
    return both.select(
        "r",
        F.when(F.col("starts").isNull(), own).otherwise(F.array_join(left, "\n")).alias("kept"),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size(covered)).alias("n_removed"),
    )
