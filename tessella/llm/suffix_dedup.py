"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``size`` bytes that also starts somewhere else goes.

1. Anchors: of the hashes of all runs of ``gram`` bytes in a string of ``size`` bytes, the
   least (of equals the rightmost) is its anchor.  Equal strings have equal anchors at the
   same place, so each start belongs to one anchor, and only strings of one anchor hash need
   to be compared.  An anchor owns a run of consecutive starts; its context is the bytes
   that their strings cover.
2. Anchor hashes are counted with their contexts' hashes (map-side combined).  A context
   that occurs twice is repeated as a whole.  What is left to compare are the distinct
   contexts of anchors that have several.
3. Those contexts, fetched from the texts, are dealt out by anchor and laid end to end in
   chunks.  A chunk's suffix array is built in two stages: suffixes smaller than their
   successors are sorted directly, the rest are induced by scans over the buckets of first
   bytes.  Adjacent common prefixes of ``size`` bytes or more show the starts that repeat.
   An anchor with more than ``most_contexts`` contexts is compared by counting the hashes
   of its strings instead (the exact way for what must not meet in one task).
4. Repeated starts become spans; each text is read with its spans once more.

Defined results: a null text counts as empty and nothing is removed from it; a text shorter
than size has no string; all copies of a repeated string go, the first included; rows are
told apart by doc_id and content: repeated rows count as occurrences of their own, and rows
of one id and different texts are kept apart; only doc_id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, split_by_flags, trimmed, utf8_column
from .fingerprints import window_minima

_U = np.uint64
_TABLE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def run_hashes(value: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hashes of all runs of k values, by doubling runs (k a power of two)."""
    run, size = value, 1
    while size < k:
        run = run[:-size] * _U(pow(base, size, 1 << 64)) + run[size:]
        size *= 2
    return mix64(run)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of base, and of its inverse modulo 2**64."""
    if base not in _TABLES or len(_TABLES[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        table = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, _U(b), dtype=_U)
            x[0] = 1
            table.append(np.cumprod(x, dtype=_U))
        _TABLES[base] = (table[0], table[1])
    return _TABLES[base]


def span_hash(value: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the spans of value, equal for equal spans."""
    power, inverse = _powers(len(value), base)
    total = np.zeros(len(value) + 1, _U)
    np.cumsum(value * power[: len(value)], out=total[1:])
    # a difference of sums holds base ** start as a factor; base is odd, so it can be undone
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))


def anchors(raw: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of the anchors of a text of at least size bytes."""
    h = run_hashes(_TABLE[raw], gram, _BASES[0])
    w = size - gram + 1
    at = window_minima(h, w)
    n = len(raw) - size + 1
    # the anchor of a start is the least hash of the w grams from it on; places ascend with starts
    value = (h[at] & _U(0xFFFFFFFFFF000000))
    first = np.empty(len(at), np.int64)
    first[0] = 0
    # an anchor takes over from a larger (or equal) one when it comes into the window, from a smaller one when that leaves
    takes = value[1:] <= value[:-1]
    first[1:] = np.where(takes, at[1:] - w + 1, at[:-1] + 1)
    last = np.append(first[1:] - 1, n - 1)
    return h[at], at, first, last


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    raw, offsets = utf8_column(b.column(1))
    for r, doc in enumerate(b.column(0).to_pylist()):
        yield doc, raw[offsets[r] : offsets[r + 1]]


CELLS = "key long, tid long, a long, c1 long, c2 long, s0 int, s1 int"


def _anchored(size: int, gram: int):
    """Rows (key, text, tid): the anchors of each text, with hashes of their contexts."""

    def batch(held: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "tid", "a", "c1", "c2", "s0", "s1"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple] = []
            total = 0
            for (key, raw), tid in zip(_rows(b), b.column(2).to_pylist(), strict=True):
                if len(raw) < size:
                    continue
                h, at, s0, s1 = anchors(raw, size, gram)
                c = [span_hash(_TABLE[raw], s0, s1 + size, x).view(np.int64) for x in _BASES]
                # the place of the anchor in its context is part of what must agree
                ids = [np.full(len(h), x, np.int64) for x in (key, tid)]
                held.append((*ids, h.view(np.int64), c[0] ^ (at - s0), c[1], s0.astype(np.int32), s1.astype(np.int32)))
                total += len(h)
                if total > 50_000:
                    yield batch(held)
                    held, total = [], 0
            if held:
                yield batch(held)

    return apply


# the two-stage suffix array


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first depth bytes (or more).

    Suffixes smaller than their successors are sorted directly.  The others are induced: a
    scan over the buckets of first bytes, in order, puts before each suffix that is in place
    the one that starts one byte earlier, if that is larger than it.
    """
    n = len(text)
    raw = text.tobytes()
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    run = np.repeat(np.arange(len(ends)), np.diff(np.append(-1, ends)))
    up = np.append(text[ends[:-1] + 1] > text[ends[:-1]], False)  # the end of the text is smaller than all
    smaller = up[run]
    direct = np.flatnonzero(smaller).tolist()
    direct.sort(key=lambda i: raw[i : i + depth])
    direct = np.array(direct, np.int64)
    out = np.full(n, -1, np.int64)
    ends_of = np.cumsum(np.bincount(text, minlength=256))
    heads = np.append(0, ends_of[:-1])
    by_byte = text[direct] if len(direct) else np.zeros(0, np.uint8)
    for c in np.unique(by_byte):  # direct ones stand at the end of their bucket
        own = direct[by_byte == c]
        out[ends_of[c] - len(own) : ends_of[c]] = own
    free = heads.copy()

    def induce(sources: np.ndarray) -> np.ndarray:
        """Places the larger suffixes before these; returns those that fall into the same bucket."""
        before = sources[sources > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return before
        c = text[before]
        order = np.argsort(c, kind="stable")
        c, before = c[order], before[order]
        values, first, count = np.unique(c, return_index=True, return_counts=True)
        slot = np.repeat(free[values] - first, count) + np.arange(len(c))
        out[slot] = before
        free[values] += count
        return before

    # the empty suffix is the least of all: what stands before it comes first
    induce(np.array([n], np.int64))
    for c in range(256):
        lo, hi = heads[c], ends_of[c]
        if lo == hi:
            continue
        done = lo
        while done < free[c]:  # induced suffixes, and those that they induce in their own bucket
            upto = free[c]
            induce(out[done:upto])
            done = upto
        direct_from = hi - int(np.count_nonzero(by_byte == c))
        induce(out[direct_from:hi])
    return out


def repeated_starts(parts: list[bytes], size: int, owned: list[int]) -> list[np.ndarray]:
    """For each part, which of its first owned starts have a string of size bytes that also starts elsewhere among the parts' owned starts."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    lens = np.array([len(p) for p in parts])
    begin = np.cumsum(lens) - lens
    own = np.zeros(len(text), bool)
    for b, k in zip(begin.tolist(), owned, strict=True):
        own[b : b + k] = True
    order = suffix_array(text, size)
    order = order[own[order]]
    # adjacent common prefixes, eight bytes at a time, as far as they matter
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1))
    same = np.arange(len(order) - 1)
    a, b = order[:-1], order[1:]
    for d in range(0, size, 8):
        step = min(d, size - 8)
        same = same[(word[a[same] + step] == word[b[same] + step]).all(axis=1)]
        if not len(same):
            break
    hit = np.zeros(len(text), bool)
    hit[order[same]] = True
    hit[order[same + 1]] = True
    return [np.flatnonzero(hit[b : b + k]) for b, k in zip(begin.tolist(), owned, strict=True)]


RUNS = "array<struct<x:int,y:int>>"
_RUN_KIND = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))


def runs_of(starts: np.ndarray) -> list[dict]:
    """Ascending numbers as runs x to y, both included."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [{"x": int(x), "y": int(y)} for x, y in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)] if len(starts) else []


def _compared(size: int, chunk: int):
    """Rows (a, c1, c2, once, k, context), those of an anchor one after the other: runs of the starts that repeat, for contexts that occur once."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[5] for r in rows], size, [r[4] for r in rows])
        hit = [k for k, f in enumerate(found) if len(f) and rows[k][3]]
        columns = [pa.array([rows[k][i] for k in hit], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([runs_of(found[k]) for k in hit], _RUN_KIND)], names=["a", "c1", "c2", "runs"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        total = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if total >= chunk and row[0] != rows[-1][0]:  # a chunk ends with an anchor's last context
                    yield work(rows)
                    rows, total = [], 0
                rows.append(row)
                total += len(row[5])
        if rows:
            yield work(rows)

    return apply


CONTEXTS = "a long, c1 long, c2 long, once boolean, k int, context binary, w1 long, w2 long"


def _contexts(size: int):
    """Rows (key, text, want): want holds (a, c1, c2, s0, s1, once, many); contexts, or the hashes of single strings for anchors with many."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int64())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["a", "c1", "c2", "once", "k", "context", "w1", "w2"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8_column(b.column(1))
            rows: list[tuple] = []
            for r, want in enumerate(b.column(2)):
                text = raw[offsets[r] : offsets[r + 1]]
                for w in want.as_py():
                    head = (w["a"], w["c1"], w["c2"], w["once"])
                    context = text[w["s0"] : w["s1"] + size]
                    if w["many"]:
                        w1, w2 = (run_any(_TABLE[context], size, x).view(np.int64).tolist() for x in _BASES)
                        rows += [(*head, k, None, x, y) for k, (x, y) in enumerate(zip(w1, w2, strict=True))]
                    else:
                        rows.append((*head, w["s1"] - w["s0"] + 1, context.tobytes(), None, None))
                    if len(rows) >= 2000:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    return apply


def run_any(value: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hashes of all runs of k values, for any k."""
    starts = np.arange(len(value) - k + 1)
    return span_hash(value, starts, starts + k, base)


RESULT = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"


def _removed(size: int):
    """Rows (doc_id, text, marks): marks holds (s0, runs), runs of repeated starts counted from s0."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                raw, offsets = utf8_column(part.column(1))
                spans, kept = [], []
                for r, marks in enumerate(part.column(2).to_pylist()):
                    text = raw[offsets[r] : offsets[r + 1]]
                    covered = np.zeros(len(text) + 1, np.int32)
                    for m in marks or ():
                        for run in m["runs"]:
                            covered[m["s0"] + run["x"]] += 1
                            covered[m["s0"] + run["y"] + size] -= 1
                    gone = np.cumsum(covered) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(text[~gone[:-1]].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return apply


def remove_repeats(docs: DataFrame, *, size: int = 400, gram: int = 64, chunk: int = 192 << 10, most_contexts: int = 1024) -> DataFrame:
    """One row for each document: doc_id, n_bytes, the removed spans of bytes, and the bytes that are kept."""
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("key"), F.xxhash64("doc_id", "text").alias("tid"))
    cells = scratch.keep(rows.select("key", "text", "tid").mapInArrow(trimmed(_anchored(size, gram)), CELLS), "anchors")

    # anchors that occur twice, and their distinct contexts
    # (kept as tables, so that a join with them can split an anchor that many documents share)
    twice = scratch.keep(cells.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "twice")
    held = scratch.keep(cells.join(twice, "a"), "held")
    scratch.drop("anchors")
    some = held.groupBy("a", "c1", "c2").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("key", "tid", "s0", "s1")])
    some = scratch.keep(some, "contexts")
    several = scratch.keep(some.groupBy("a").agg(F.count("*").alias("m")).where("m > 1"), "several")
    compare = some.join(several, "a")
    want = F.struct("a", "c1", "c2", "s0", "s1", (F.col("n") == 1).alias("once"), (F.col("m") > most_contexts).alias("many"))
    wants = scratch.keep(compare.groupBy("key", "tid").agg(F.collect_list(want).alias("want")), "wants")

    # their bytes, from the texts that hold them
    flagged, _ = split_by_flags(rows, wants, "tid", scratch, "flags-1")
    fetched = scratch.keep(flagged.join(wants, ["key", "tid"]).dropDuplicates(["key", "tid"]).select("key", "text", "want").mapInArrow(trimmed(_contexts(size)), CONTEXTS), "fetched", packed=True)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = fetched.where("context is not null").select("a", "c1", "c2", "once", "k", "context").repartition(tasks, "a").sortWithinPartitions("a")
    found = scratch.keep(dealt.mapInArrow(trimmed(_compared(size, chunk)), f"a long, c1 long, c2 long, runs {RUNS}"), "found")
    single = fetched.where("w1 is not null")
    again = single.groupBy("a", "w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("a", "w1", "w2")
    counted = single.where("once").join(again, ["a", "w1", "w2"]).groupBy("a", "c1", "c2").agg(F.transform(F.sort_array(F.collect_set("k")), lambda k: F.struct(k.alias("x"), k.alias("y"))).alias("runs"))
    whole = some.where("n > 1").select("a", "c1", "c2", F.array(F.struct(F.lit(0).alias("x"), (F.col("s1") - F.col("s0")).alias("y"))).alias("runs"))
    verdict = whole.unionAll(found).unionAll(counted)

    marks = held.join(verdict, ["a", "c1", "c2"]).groupBy("key", "tid").agg(F.collect_set(F.struct("s0", "runs")).alias("marks"))
    marks = scratch.keep(marks, "marks")
    flagged, others = split_by_flags(rows, marks, "tid", scratch, "flags-2")
    cut = flagged.join(marks, ["key", "tid"], "left").select("doc_id", "text", "marks")
    kind = cut.schema["marks"].dataType
    return cut.unionAll(others.select("doc_id", "text", F.lit(None).cast(kind).alias("marks"))).mapInArrow(trimmed(_removed(size)), RESULT)
