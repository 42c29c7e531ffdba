"""Jaccard join on word n-grams by blocked sparse products of the document by n-gram matrix.

1. Count every n-gram of every document into a table of fixed size (hashed), which orders
   n-grams from rare to common.  Any fixed order gives exact results; this one keeps common
   passages out of the prefixes.
2. A document's row is its set of n-grams.  Equal sets are one row from here on.
3. Size bounds: two rows that reach the similarity share n-grams among the first
   n - ceil(t n) + 1 of each, and their sizes lie in the same or neighbouring bands.  So the
   columns are prefix n-grams, each cut into groups by band.
4. First product: in every column group the row whose n-grams are most common (in a family of
   copies, what the others were made from) is the pivot.  The block of pivots is multiplied
   with the rows of their columns: linear in the group, and it settles most families.  The
   links so found give classes.
5. Second product: a column group whose rows, the pivot aside, still are of several classes is
   open.  Open columns are put together into blocks of bounded size, and each block of the
   incidence is multiplied with itself; a hot column is cut by rows, and those of its commonest
   class don't meet each other.  A pair in one class can't change the classes and is dropped,
   like a pair whose sizes don't reach the similarity, or whose overlap is below the bound that
   follows from its sizes.
6. Both products go over the prefixes first; what reaches the bounds there is multiplied over
   the whole sets.  Links give the classes (connected components).

Every link comes from a product, at every size; no group is multiplied in one task, and none
is capped.

Defined results: a null or blank text has an empty set and is linked with nothing; a text of
fewer than n words is one n-gram; repeated rows (also of one id) are rows with equal sets; a
null doc_id takes part, but names no class unless all of the class are null; only doc_id and
the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import COUNTS, Scratch, combine, count_tables, mix64, sequence_hash, split_by_flags, summed_table, trimmed, utf8_blocks, word_hashes
from .graph import components

#: Cells of the table of counts: 2**20 in 16 slots, 4 MB, whatever the input.
SLOTS, WIDTH = 16, 1 << 16
#: Rows of a column group that are multiplied in one task; larger groups are cut.
MOST_ROWS = 1024
_U = np.uint64


def row_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for i, j, raw, offsets in utf8_blocks(column):
        words, indptr, _, _ = word_hashes(raw, offsets)
        grams = combine(words, n)
        for r in range(j - i):
            a, b = int(indptr[r]), int(indptr[r + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield np.array([sequence_hash(words[a:b])], dtype=_U)
            else:
                yield np.zeros(0, _U)


def _cell(x: np.ndarray) -> np.ndarray:
    return (x >> _U(44)).astype(np.int64)


def _counter(n: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS * WIDTH, dtype=np.uint32)
        for b in batches:
            held: list[np.ndarray] = []
            size = 0
            for x in row_sets(b.column(0), n):
                held.append(_cell(x))
                size += len(x)
                if size > 500_000:
                    total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
        yield from count_tables(total, TaskContext.get().partitionId(), SLOTS)

    return apply


def signature(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit numbers."""
    a = mix64(x ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U)
    b = mix64(x * _U(0xD6E8FEB86659FD93)).sum(dtype=_U) + _U(len(x)) if len(x) else _U(0)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _described(n: int, percent: int, held):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held.value
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            size, hi, lo, common, prefix = [], [], [], [], []
            for x in row_sets(b.column(2), n):
                c = count[_cell(x)]
                size.append(len(x))
                h, w = signature(x)
                hi.append(h)
                lo.append(w)
                # the rarer its n-grams, the larger: 20 bits, and the size behind them
                rare = (1 << 20) - 1 - int(np.log2(c.astype(float) + 1).mean() * 30000) if len(x) else 0
                common.append((max(rare, 0) << 40) | len(x))
                prefix.append(x[np.lexsort((x, c))[: prefix_length(len(x), percent)]].view(np.int64) if len(x) else np.zeros(0, np.int64))
            ends = np.zeros(len(prefix) + 1, np.int32)
            np.cumsum([len(p) for p in prefix], out=ends[1:])
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(common, pa.int64()), grams], names=["doc_id", "tid", "n", "hi", "lo", "pk", "prefix"])

    return apply


def _sets_of(n: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                hi, lo, sets = [], [], []
                for x in row_sets(b.column(1).slice(i, 500), n):
                    h, w = signature(x)
                    hi.append(h)
                    lo.append(w)
                    sets.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 500), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sets, pa.binary())], names=["tid", "hi", "lo", "grams"])

    return apply


def reaches(overlap, size_a, size_b, percent: int):
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def prefix_overlap(size_a, size_b, percent: int):
    """The least number of prefix n-grams that two rows of these sizes share if they reach the similarity."""
    least = -(-percent * (size_a + size_b) // (100 + percent))  # of the whole sets
    outside = lambda n: -(-percent * n // 100) - 1
    return np.maximum(least - np.maximum(outside(size_a), outside(size_b)), 1)


@dataclass(frozen=True)
class Block:
    """Rows of the incidence matrix: entry e says that row[e] holds n-gram gram[e]; rows have sizes and classes."""

    uid: np.ndarray
    root: np.ndarray
    size: np.ndarray
    row: np.ndarray
    gram: np.ndarray

    def part(self, rows: np.ndarray) -> Block:
        new = np.full(len(self.uid), -1)
        new[rows] = np.arange(len(rows))
        held = new[self.row] >= 0
        return Block(self.uid[rows], self.root[rows], self.size[rows], new[self.row[held]], self.gram[held])


def product(left: Block, right: Block, percent: int, slab: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left row, right row, overlap) of the pairs of different classes whose sizes can reach the similarity.

    Rows of the left block are taken in slabs of about slab products, whose overlap counts are
    accumulated sparsely: memory follows the slab, not the number of pairs.
    """
    order = np.argsort(right.gram, kind="stable")
    grams, rows = right.gram[order], right.row[order]
    lo = np.searchsorted(grams, left.gram, side="left")
    count = np.searchsorted(grams, left.gram, side="right") - lo
    by_row = np.argsort(left.row, kind="stable")
    by_row = by_row[count[by_row] > 0]
    done = np.cumsum(count[by_row])
    at = 0
    while at < len(by_row):
        before = done[at - 1] if at else 0
        end = max(int(np.searchsorted(done, before + slab)), at + 1)
        end = int(np.searchsorted(left.row[by_row], left.row[by_row[end - 1]], side="right"))  # whole rows
        own = by_row[at:end]
        n = count[own]
        total = int(n.sum())
        i = np.repeat(left.row[own], n)
        j = rows[np.repeat(lo[own] - np.cumsum(n) + n, n) + np.arange(total)]
        a, b = left.size[i], right.size[j]
        keep = (left.root[i] != right.root[j]) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)
        pair, overlap = np.unique(i[keep] * len(right.uid) + j[keep], return_counts=True)
        yield pair // max(len(right.uid), 1), pair % max(len(right.uid), 1), overlap
        at = end


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same classes, one for each row but the least of its class."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        new = root.copy()
        np.minimum.at(new, root[i], root[j])
        np.minimum.at(new, root[j], root[i])
        new = np.minimum(new, new[root])
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    rest = np.flatnonzero(root != np.arange(len(names)))
    return names[root[rest]], names[rest]


def _multiplied(percent: int, whole: bool):
    """Rows (task, side, uid, root, n, grams) of two blocks, or of one with itself: the pairs (a, b) that can reach the similarity as far as prefixes tell, or, over whole sets, links that give the classes of all pairs that do."""

    def apply(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        grams = table["grams"].chunk(0) if table["grams"].num_chunks else pa.array([], pa.binary())
        sets = [np.frombuffer(x.as_buffer(), _U) for x in grams]
        both = Block(*(table[c].to_numpy() for c in ("uid", "root", "n")), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets) if sets else np.zeros(0, _U))
        side = table["side"].to_numpy()
        one, two = (np.flatnonzero(side == k) for k in (0, 1))
        left = both.part(one)
        right = both.part(two) if len(two) else left
        found = [np.zeros((2, 0), np.int64)]
        for i, j, overlap in product(left, right, percent):
            a, b = left.size[i], right.size[j]
            ok = reaches(overlap, a, b, percent) if whole else overlap >= prefix_overlap(a, b, percent)
            if not len(two):
                ok &= i < j
            found.append(np.stack([left.uid[i[ok]], right.uid[j[ok]]]))
        a, b = np.concatenate(found, axis=1)
        if whole:
            a, b = forest(a, b)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return apply


def _band(percent: int):
    """Bands of sizes: rows that reach the similarity are in the same or neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100) * 1.000001)).cast("int")


def _sizes_reach(percent: int):
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def _dealt(pairs: DataFrame, block_grams: int) -> DataFrame:
    """The rows that each task multiplies (task, side, uid), for pairs (a, b; with sizes na, nb).

    A task takes several rows a and what they are paired with, about block_grams n-grams; a row
    a with more partners than that has its partners dealt out.
    """
    degree = pairs.groupBy("a").agg((F.first("na") + F.sum("nb")).alias("weight"))
    total = degree.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    buckets = max(1, 2 * total // block_grams)
    parts = F.ceil(F.col("weight") / float(block_grams)).cast("int")
    dealt = pairs.join(degree.select("a", parts.alias("parts")), "a")
    # a row of several parts has tasks of its own
    task = F.when(F.col("parts") > 1, F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("a"), F.lit(buckets)))
    dealt = dealt.select(task.alias("task"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("uid")), F.struct(F.lit(1).alias("side"), F.col("b").alias("uid")))).alias("x"))
    return dealt.select("task", "x.side", "x.uid").distinct()


def _products(work: DataFrame, percent: int, whole: bool) -> DataFrame:
    """The pairs (a, b) that reach the similarity, or can, by a product in each task of work (task, side, uid, root, n, grams)."""
    return work.select("task", "side", "uid", "root", "n", "grams").groupBy("task").applyInArrow(_multiplied(percent, whole), "a long, b long")


def _verified(met: DataFrame, sets: DataFrame, rows: DataFrame, n: int, percent: int, block_grams: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs of met (a, b) that reach the similarity, by products over whole sets, which are computed once more from their texts.

    A set is told by the row that stands for it and by its signature, so that of copies one is
    sent; it goes from its row to the tasks that multiply it at once.
    """
    met = scratch.keep(met.distinct(), f"{name}-met", free=True)
    wanted = scratch.keep(met.select(F.col("a").alias("uid")).unionAll(met.select("b")).distinct().join(sets.select("uid", "hi", "lo", "n", "tid"), "uid"), f"{name}-wanted")
    flagged, _ = split_by_flags(rows.select("tid", "text"), wanted.select("tid"), "tid", scratch, f"{name}-flags")
    computed = flagged.select("tid", "text").mapInArrow(trimmed(_sets_of(n)), "tid long, hi long, lo long, grams binary")
    size = lambda c, k: wanted.select(F.col("uid").alias(c), F.col("n").alias(k))
    work = _dealt(met.join(size("a", "na"), "a").join(size("b", "nb"), "b"), block_grams).join(wanted, "uid")
    # repeated rows have one set; the grouping keeps to the join's partitions
    row = ["tid", "hi", "lo"]
    work = computed.join(work, row).groupBy(*row, "task", "side", "uid", "n").agg(F.first("grams").alias("grams"))
    return scratch.keep(_products(work.withColumn("root", F.col("uid")), percent, True), name, free=True)


def _classes(docs: DataFrame, n: int, percent: int, block_grams: int = 400_000) -> tuple[DataFrame, DataFrame, Scratch]:
    """Documents (doc_id, tid, n, hi, lo), and their distinct sets that aren't empty: hi, lo, first_id, root (one for each class), component_id."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("tid"), "text")

    count = sc.broadcast(summed_table(rows.select("text").mapInArrow(trimmed(_counter(n)), COUNTS), SLOTS, WIDTH))
    meta = scratch.keep(rows.mapInArrow(trimmed(_described(n, percent, count)), "doc_id long, tid long, n long, hi long, lo long, pk long, prefix array<long>"), "meta")
    count.unpersist()
    sets = meta.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "tid")).alias("t"), F.first("n").alias("n"), F.first("pk").alias("pk"), F.first("prefix").alias("prefix"))
    sets = sets.select("hi", "lo", "first_id", F.col("t.tid").alias("tid"), "n", "pk", "prefix", F.monotonically_increasing_id().alias("uid"))
    sets = scratch.keep(sets, "sets", free=True)
    slim = scratch.keep(meta.drop("pk", "prefix"), "slim")
    scratch.drop("meta")

    # columns with at least two rows, cut into groups of neighbouring size bands
    # (tables that grow with the input are joined by sorting, at every size)
    cells = sets.select("uid", "pk", F.explode("prefix").alias("s"))
    columns = cells.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s")
    columns = scratch.keep(columns, "columns", free=True)
    size = lambda c: F.col(c).bitwiseAND((1 << 40) - 1)
    banded = cells.join(columns.hint("merge"), "s").withColumn("n", size("pk")).withColumn("band", _band(percent)).select("s", "uid", "pk", F.explode(F.array("band", F.col("band") + 1)).alias("g"))
    banded = scratch.keep(banded, "banded", free=True)
    groups = banded.groupBy("s", "g").agg(F.count("*").alias("rows"), F.min(F.struct("pk", "uid")).alias("p")).where("rows > 1").select("s", "g", F.col("p.uid").alias("pivot"), size("p.pk").alias("na"))
    shared = scratch.keep(banded.join(groups.hint("merge"), ["s", "g"]).select("s", "g", "uid", size("pk").alias("n"), "pivot", "na"), "shared", free=True)
    scratch.drop("banded")
    scratch.drop("columns")

    # the first product: pivots by the rows of their columns
    stars = shared.where("uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b"), "na", F.col("n").alias("nb")).where(_sizes_reach(percent)).distinct()
    stars = scratch.keep(stars, "stars", free=True)
    starred = stars.select(F.col("a").alias("uid")).unionAll(stars.select("b"))
    work = _dealt(stars, block_grams).join(_entries(sets, starred, scratch, "starred"), "uid")
    met = _products(work.withColumn("root", F.col("uid")), percent, False)
    links = _verified(met, sets, rows, n, percent, block_grams, scratch, "links-1")
    classes = components(links, scratch, "cc1").select(F.col("v").alias("uid"), "root")

    # the second product: blocks that share a column of several classes
    classed = scratch.keep(shared.join(classes, "uid", "left").withColumn("root", F.coalesce("root", "uid")).select("s", "g", "uid", "root", "pivot"), "classed")
    scratch.drop("shared")
    others = F.when(F.col("uid") != F.col("pivot"), F.col("root"))
    still = classed.groupBy("s", "g").agg(F.min(others).alias("r0"), F.max(others).alias("r1"), F.count("*").alias("rows"), F.min("uid").alias("anchor")).where("r0 < r1")
    still = scratch.keep(still.select("s", "g", "rows", "anchor"), "still", free=True)
    parts = still.groupBy("anchor").agg(F.ceil(F.sum("rows") / float(16 * MOST_ROWS)).cast("int").alias("parts"))
    left = classed.join(still.join(parts, "anchor").hint("merge"), ["s", "g"]).select("s", "g", "uid", "root", "rows", "anchor", "parts")
    left = scratch.keep(left, "open", free=True)
    if not left.isEmpty():
        met = _block_products(left, sets, scratch, percent, block_grams)
        links = links.unionAll(_verified(met, sets, rows, n, percent, block_grams, scratch, "links-2"))
        classes = components(links, scratch, "cc2").select(F.col("v").alias("uid"), "root")

    named = sets.select("hi", "lo", "uid", "first_id").join(classes, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = scratch.keep(named.join(names, "root").select("hi", "lo", "first_id", "root", "component_id"), "named")
    for name in ("sets", "classed", "still", "open", "placed", "dealt", "held", "stars", "starred"):
        scratch.drop(name)
    return slim, named, scratch


def _block_products(cells: DataFrame, sets: DataFrame, scratch: Scratch, percent: int, block_grams: int, most_rows: int = MOST_ROWS) -> DataFrame:
    """Pairs (a, b) of rows of open columns (cells: s, g, uid, root, rows, anchor, parts) that can reach the similarity as far as their prefixes tell.

    Blocks are made of columns: those with the same least row (anchor) are likely to hold the
    same rows, so they are put together, about block_grams entries at a time, and a block is
    multiplied with itself.  Each cell goes to one block.  A column of more than most_rows rows
    is cut by rows: parts of its commonest class, which need not meet each other, and parts of
    all others, which meet all.
    """
    hot = F.col("rows") > most_rows
    # ordinary columns, by anchor
    dealt = cells.where(~hot).select(F.col("anchor").alias("x"), F.pmod(F.xxhash64("s"), F.col("parts")).alias("y"), "uid", "root").distinct()
    weight = sets.select("uid", F.size("prefix").alias("w"))
    dealt = scratch.keep(scratch.keep(dealt, "placed").join(weight, "uid"), "dealt", free=True)
    total = dealt.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    bucket = F.pmod(F.xxhash64("x", "y"), F.lit(max(1, 2 * total // block_grams)))
    work = dealt.select(bucket.alias("task"), F.lit(0).alias("side"), "uid", "root").distinct()

    # hot ones, by row parts
    large = cells.where(hot)
    most = large.groupBy("s", "g", "root").agg(F.count("*").alias("n")).groupBy("s", "g").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("m1"), F.sum("n").alias("m"))
    cut = lambda n: F.ceil(n / float(most_rows)).cast("int")
    large = large.join(most.select("s", "g", "main", cut(F.col("m1")).alias("p1"), cut(F.col("m") - F.col("m1")).alias("p2")), ["s", "g"])
    large = large.withColumn("own", F.when(F.col("root") == F.col("main"), F.pmod(F.xxhash64("uid"), F.col("p1"))).otherwise(F.col("p1") + F.pmod(F.xxhash64("uid"), F.col("p2"))).cast("int"))
    first = F.when(F.col("own") < F.col("p1"), F.col("p1")).otherwise(F.lit(0))
    large = large.withColumn("other", F.explode(F.sequence(first, F.col("p1") + F.col("p2") - 1)))
    task = F.xxhash64("s", "g", F.least("own", "other"), F.greatest("own", "other"))
    work = work.unionAll(large.select(task.alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"), "uid", "root"))

    return _products(work.join(_entries(sets, cells, scratch, "held"), "uid"), percent, False)


def _entries(sets: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The entries (uid, n, grams) of the prefixes of some rows and by chance of others: all that a join with the rows needs to shuffle."""
    key = F.xxhash64("uid").alias("key")
    own, _ = split_by_flags(sets.select("uid", "n", "prefix", key), rows.select(key), "key", scratch, name)
    return own.select("uid", "n", "prefix").mapInArrow(_packed, "uid long, n long, grams binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uid, n, prefix) with the prefix as bytes."""
    for b in batches:
        x = b.column(2)
        values, offsets = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([values[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["uid", "n", "grams"])


def join(docs: DataFrame, *, n: int = 4, percent: int = 85, block_grams: int = 400_000) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the least doc_id of its class)."""
    slim, named, _ = _classes(docs, n, percent, block_grams)
    found = slim.where("n > 0").join(named.select("hi", "lo", "component_id"), ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionAll(slim.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, *, n: int = 4, percent: int = 85, block_grams: int = 400_000) -> DataFrame:
    """The rows of docs, all columns, that stand for their class: one row with its least doc_id for each.

    Of a class without ids one row stays as well.  Rows are told apart by id and text, so that
    neither rows without an id nor other texts of a repeated id stay beside them; of the texts
    of the least id the one with the least hash stays, and of rows of one id and text the least
    in the order of their other columns.  Blank texts have no class and stay, repeated rows once.
    Only documents that may be dropped are shuffled.
    """
    slim, named, scratch = _classes(docs, n, percent, block_grams)
    same = slim.groupBy("doc_id", "tid").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("hi").alias("hi"), F.first("lo").alias("lo"))
    classed = scratch.keep(same.where("n > 0").join(named.select("hi", "lo", "root"), ["hi", "lo"]), "rows")
    # nulls last: a null id stands for its class only where all are null
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tid")
    heads = classed.groupBy("root").agg(F.min(order).alias("head"))
    own = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tid") == F.col("head.tid"))
    known = classed.join(heads, "root").select("doc_id", "tid", "copies", own.alias("stays"))
    verdict = known.unionAll(same.where("n = 0").select("doc_id", "tid", "copies", F.lit(True).alias("stays"))).where("not stays or copies > 1")
    verdict = scratch.keep(verdict.select(F.col("doc_id").alias("k"), F.col("tid").alias("t"), "stays"), "verdicts")

    key = F.col("doc_id").cast("long")
    rows = docs.select(F.struct("*").alias("row"), key.alias("doc_id"), F.xxhash64(key, F.col("text")).alias("tid"))
    flagged, others = split_by_flags(rows, verdict.select(F.col("t").alias("tid")), "tid", scratch, "dropped")
    judged = flagged.join(verdict, (F.col("tid") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("k")), "left")
    once = judged.where("stays").groupBy("doc_id", "tid").agg(F.min("row").alias("row"))
    return others.select("row.*").unionAll(judged.where("stays is null").select("row.*")).unionAll(once.select("row.*"))
