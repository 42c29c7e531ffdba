"""Document fingerprints by winnowing.

The hashes (40 bits) of all runs of k characters are taken, and from every w neighbouring ones
the least is kept, of equals the rightmost.  Any run of w + k - 1 characters that two texts
share has a kept hash, at the same place of the run, in both; positions are kept with the
hashes, so that matches can be located.

Defined results: a null text counts as empty and has an empty fingerprint; a text shorter
than k is one gram, hashed with its length; repeated rows have equal fingerprints; two empty
fingerprints are alike (1.0), an empty and another are not (0.0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import mix64

_U = np.uint64
K, W = 16, 64
#: Hashes are the upper 40 bits, so that they and a place fit into 64 when windows are compared.
_TOP = _U(0xFFFFFFFFFF000000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(code: np.ndarray, k: int) -> np.ndarray:
    """Hash of the run of k code points at each place, built by doubling runs."""
    if len(code) < k:
        return np.zeros(0, _U)
    base = 0x9E3779B97F4A7C15
    power = lambda n: _U(pow(base, n, 1 << 64))
    run, size = code.astype(_U), 1
    whole: np.ndarray | None = None
    done = 0
    n = len(code) - k + 1
    left = k
    while left:
        if left & 1:
            part = run[done : done + n]
            whole = part.copy() if whole is None else whole * power(size) + part
            done += size
        left >>= 1
        if left:
            run = run[:-size] * power(size) + run[size:]
            size *= 2
    return mix64(whole)


def window_minima(value: np.ndarray, w: int) -> np.ndarray:
    """Ascending places of the rightmost least value of every window of w neighbours (of all, if there are fewer).

    Values are compared by their upper 40 bits.
    """
    n = len(value)
    if not n:
        return np.zeros(0, np.int64)
    w = min(w, n)
    out = []
    mask = (1 << 24) - 1
    for first in range(0, n - w + 1, 1 << 22):
        part = value[first : first + (1 << 22) + w - 1]
        least = (part & _U(~mask & 0xFFFFFFFFFFFFFFFF)) | (_U(mask) - np.arange(len(part), dtype=_U))
        size = 1
        while size * 2 <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < w:
            least = np.minimum(least[: len(part) - w + 1], least[w - size :])
        out.append(first + mask - (np.unique(least & _U(mask))[::-1]).astype(np.int64))
    return np.unique(np.concatenate(out))


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept of a text."""
    if not text:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    code = code_points(text)
    if len(code) < k:
        whole = gram_hashes(code, len(code)) * _U(0xC4CEB9FE1A85EC53) + _U(len(code))
        return mix64(whole) & _TOP, np.zeros(1, np.int64)
    h = gram_hashes(code, k) & _TOP
    at = window_minima(h, w)
    return h[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the hashes of either fingerprint that are in both."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, at: np.ndarray) -> tuple[str, list[int]]:
    """The distinct kept hashes, ascending, 10 hexadecimal digits each, and the last place of each."""
    order = np.lexsort((-at, hashes))
    own, first = np.unique(hashes[order], return_index=True)
    digits = (own >> _U(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return digits.tobytes().hex(), at[order][first].tolist()


def fingerprint(docs: DataFrame, *, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """All columns of docs but the text, with the kept hashes (signed) and their positions as arrays."""
    rest = docs.drop("hashes", "positions")
    rest = rest.select(*[c for c in rest.columns if c != text], text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                kept = [winnow(t, k, w) for t in part.column(part.num_columns - 1).to_pylist()]
                hashes = pa.array([h.view(np.int64) for h, _ in kept], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], hashes, pa.array([p for _, p in kept], pa.list_(pa.int64()))], names=[*part.schema.names[:-1], "hashes", "positions"])

    kind = ArrayType(LongType())
    return rest.mapInArrow(apply, StructType([*rest.schema.fields[:-1], StructField("hashes", kind), StructField("positions", kind)]))


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>, edited_positions array<int>"


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many characters from the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(k: int, w: int):
    """Rows (p, extra, doc_id, text) in order; the first extra row of a range only follows the others."""

    def result(row: tuple, following: tuple) -> tuple:
        doc, text, (own, at) = row
        new = edited(text, following[1])
        other, other_at = winnow(new, k, w)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        (print_, places), (new_print, new_places) = digest(own, at), digest(other, other_at)
        return doc, len(text), sha, print_, new_print, likeness(own, other), likeness(own, following[2][0]), places, new_places

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions", "edited_positions"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, closed = None, None, False
        out: list[tuple] = []
        for b in batches:
            for p, extra, doc, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if p != part:
                    part, last, closed = p, None, False
                if closed or (extra and last is None):
                    continue
                text = cell.as_py()
                row = (doc, text, winnow(text, k, w))
                if last is not None:
                    out.append(result(last, row))
                    if len(out) >= 1000:
                        yield batch(out)
                        out = []
                last, closed = row, bool(extra)
        if out:
            yield batch(out)

    return apply


def compare_with_next(docs: DataFrame, *, ranges: int | None = None, k: int = K, w: int = W) -> DataFrame:
    """Each document beside its edited text, whose last half is the start of the next document's.

    positions holds the place of each hash of the fingerprint, in its order, so that a match of
    two fingerprints can be located in both texts.

    Documents are ordered by doc_id (nulls first), then text, and the last is followed by the
    first.  They are dealt out in ranges whose bounds are ids that occur, so the only text a
    range needs from outside is its successor's first; those few are dealt out twice.  The
    texts are shuffled once.  The driver receives the bounds, one for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    n = ranges or 4 * tasks
    seen = rows.select(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("no_id"), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("at")).first()
    bounds = np.array(sorted(set(seen["at"] or ()) - {seen["least"]}), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.searchsorted(bounds, ids[known].to_numpy(dtype=np.int64), side="right")
        return pd.Series(out)

    p = F.col("p")
    is_bound = F.col("doc_id").isin(bounds.tolist()) if len(bounds) else F.lit(False)
    is_first = F.col("doc_id").isNull() if seen["no_id"] else F.col("doc_id") == F.lit(seen["least"])
    place = lambda where, extra: F.struct(where.cast("int").alias("p"), F.lit(extra).alias("extra"))
    places = F.filter(F.array(place(p, 0), F.when(is_bound, place(p - 1, 1)), F.when(F.coalesce(is_first, F.lit(False)), place(F.lit(len(bounds)), 1))), lambda x: x.isNotNull())
    # an id of 64 bits would lose digits as a pandas float where nulls are mixed in
    dealt = rows.withColumn("p", F.when(F.col("doc_id").isNull(), 0).otherwise(range_of(F.coalesce("doc_id", F.lit(0)))))
    dealt = dealt.select(F.explode(places).alias("x"), "doc_id", "text").select("x.p", "x.extra", "doc_id", "text")
    dealt = dealt.repartition(tasks, "p").sortWithinPartitions("p", "extra", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_compared(k, w), COMPARED)
