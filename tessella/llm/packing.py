"""Best-fit packing of token sequences by hierarchical residual packing.

Each task tokenizes its documents, cuts the longer ones, and packs the pieces best-fit
in descending length.  Bins that are nearly full are done.  Underfull bins become items
themselves (their members travel with them), are dealt into fewer groups, and are packed
best-fit again; this repeats, each level a written table, until one group holds all that
is left or a round no longer saves bins.  No group holds more than about ``group_bins``
bins, whatever the input.

Defined results: a null text is empty and yields the separator alone; repeated rows are
packed each on its own; a null doc_id stays null; other columns are not read.  Which
bins meet depends on the layout of the input; every piece appears exactly once and the
offsets of a sequence are gapless.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, trimmed
from .token_counts import _Cache

MEMBER = np.dtype([("doc", "<i8"), ("start", "<i8"), ("piece", "<i4"), ("length", "<i4"), ("crc", "<u4"), ("known", "u1")])
#: Words cut at a single space are safe unless a space stands after white space and before white space or the end.
_LOOSE = re.compile(r"\s (?:\s|\Z)|\A(?: \s|\s\Z)")
BINS = "total int, members binary"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def byte_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The ranks (bytes of a token: id) and special tokens of a byte-level vocabulary file in JSON.

    Such a file writes each byte as one visible character: bytes that are visible themselves,
    and the others in order from U+0100 on.  Merges must stand in the order of their ids,
    which makes ids ranks.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    vocab = whole["model"]["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in whole["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError(f"the merges of {path} aren't in the order of their ids")
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in special}, special


class ByteEncoder:
    """Ids of texts in a byte-level vocabulary, as little-endian uint32 bytes, with a bounded cache of words.

    A piece of the split pattern never holds a space but as its first character, so a
    text may be cut before a space that follows another kind of character.
    """

    def __init__(self, path: str, pattern: str, cached_words: int = 250_000):
        ranks, special = byte_ranks(path)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.find_special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.after_space = _Cache(lambda w: self._ids(" " + w), cached_words)

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if _LOOSE.search(text):
            return self._ids(text)
        words = text.split(" ")
        return (self._ids(words[0]) if words[0] else b"") + b"".join(map(self.after_space.__getitem__, words[1:]))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.find_special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(path, pattern)


def cut(ids: bytes, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of len(ids) / 4 tokens: all full but the first, if it is longer than size."""
    n = len(ids) // 4
    first = n % size or size
    return [(0, min(n, first))] + [(s, size) for s in range(first, n, size)]


def best_fit(sizes: list[int], size: int) -> list[list[int]]:
    """Indices of the items of each bin: each item, longest first, goes to the bin with the least room that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[k]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[own].append(k)
            room -= n
        else:
            own, room = len(bins), size - n
            bins.append([k])
        if room:
            by_room[room].append(own)
            rooms |= 1 << room
    return bins


def _packed(sizes: list[int], members: list[bytes], size: int) -> Iterator[pa.RecordBatch]:
    bins = best_fit(sizes, size)
    for i in range(0, len(bins), 10_000):
        part = bins[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([sum(sizes[k] for k in b) for b in part], pa.int32()), pa.array([b"".join([members[k] for k in b]) for b in part], pa.binary())], names=["total", "members"])


def _tokenized(path: str, pattern: str, size: int, most_items: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        sizes: list[int] = []
        members: list[bytes] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode(text.as_py()) + b"\0\0\0\0"
                for k, (start, n) in enumerate(cut(ids, size)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
                    sizes.append(n)
                    members.append(np.array([(doc or 0, start, k, n, crc, doc is not None)], dtype=MEMBER).tobytes())
            if len(sizes) >= most_items:
                yield from _packed(sizes, members, size)
                sizes, members = [], []
        yield from _packed(sizes, members, size)

    return apply


def _repacked(size: int, most_items: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: list[int] = []
        members: list[bytes] = []
        for b in batches:
            sizes += b.column(0).to_pylist()
            members += b.column(1).to_pylist()
            if len(sizes) >= most_items:
                yield from _packed(sizes, members, size)
                sizes, members = [], []
        yield from _packed(sizes, members, size)

    return apply


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = TaskContext.get().partitionId() << 36
    for b in batches:
        if not b.num_rows:
            continue
        rows = [np.frombuffer(x, dtype=MEMBER) for x in b.column(1).to_pylist()]
        m = np.concatenate(rows)
        seq = np.repeat(own + np.arange(len(rows)), [len(r) for r in rows])
        own += len(rows)
        offset = np.concatenate([np.cumsum(r["length"]) - r["length"] for r in rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array(m["doc"].copy(), mask=m["known"] == 0), *(pa.array(x) for x in (m["piece"].copy(), m["start"].copy(), m["length"].astype(np.int64), m["crc"].astype(np.int64), seq, offset.astype(np.int64)))],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, path: str, pattern: str, *, size: int = 2048, slack: int = 16, group_bins: int = 10_000, fan_in: int = 8, most_items: int = 200_000) -> DataFrame:
    """One row for each piece of every document, with its sequence and its place there.

    path is a byte-level vocabulary in JSON, pattern the one that splits its words.  Rounds go
    on until all that is left met in one group, or a round saves no bin.  A bin with at most slack tokens of room is done.  A task packs at most most_items at once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    level = scratch.keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(_tokenized(path, pattern, size, most_items)), BINS), "level-0")
    done, under = [level.where(F.col("total") >= size - slack)], level.where(F.col("total") < size - slack)
    left, groups = under.count(), 1 << 62
    k = 0
    while left > 1:
        k += 1
        groups = max(1, -(-left // group_bins), min(groups, max(1, level.rdd.getNumPartitions())) // fan_in)
        level = scratch.keep(under.repartition(groups, F.xxhash64("members")).mapInArrow(trimmed(_repacked(size, most_items)), BINS), f"level-{k}")
        now = level.where(F.col("total") < size - slack)
        after = now.count()
        done.append(level.where(F.col("total") >= size - slack))
        saved, left, under = left - after, after, now
        if groups == 1 or not saved:
            break
    out = under
    for d in done:
        out = out.unionAll(d)
    return out.mapInArrow(_unfolded, PIECES)
