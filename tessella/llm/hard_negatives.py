"""Hard negatives of anchors by integer inner products, taken bit-plane by bit-plane.

Components are whole numbers.  A block of anchors meets a block of rows in one task.  A row's
components, moved up to be non-negative, are read as bit-planes, the most significant first; each
plane adds one 0/1 product.  What the planes to come can add lies in an interval: at most half
their range times the anchor's absolute sum, and at most the anchor's length times that of what is
left of the row (Cauchy-Schwarz).  A pair is dropped once its interval can't reach the scores that
still count: the fifth best so far for positives, the windows below the positives' scores for
negatives.  While many pairs live, planes are matrix products; then pair by pair.

Two rounds: the best rows of an anchor's own label (its positives), then for each positive the best
rows of other labels whose score lies within two percentages of the positive's.  Every round deals
(anchor block, row block) pairs to tasks, each hands on its best few for each anchor, and windows
over these pick the best.  No block grows with the input, and nothing goes through the driver.

Defined results: rows take no part if the id, the label, the vector or a component is null, a
component isn't finite, or components are so large that products could pass 2**50 (size times the
greatest square).  Missing components of shorter vectors count as 0.  Rows that repeat id, label and
vector count once; rows that share only the id each count, but never as positives or negatives of
that id.  Of equal scores the lesser id comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Anchors and rows of a block; rows are gone through in tiles.
ANCHORS, ROWS, TILE = 1024, 16384, 2048
#: Below this share of living pairs, planes are added pair by pair.
SPARSE = 1 / 32

FOUND = "no long, anchor_id long, place int, positive_id long, positive_score long, other long, score long"
_FOUND = [("no", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("other", pa.int64()), ("score", pa.int64())]


def quantized(vec: Column, scale: float) -> Column:
    """floor(scale * x) of every component, as long; null where a component is null or not finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vec, lambda x: F.floor(x.cast("double") * scale)))


def matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def living_pairs(a: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray, best: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the allowed pairs with low <= score <= high, and maybe no others; scores are exact.

    With best, pairs below the best-th score of an anchor's may be left out as well.
    """
    none = np.zeros(0, np.int64)
    if not len(a) or not len(c):
        return none, none, none
    width = max(a.shape[1], c.shape[1])
    a, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, c))
    top = int(np.abs(c).max(initial=0)).bit_length()
    u, f = c + (1 << top), a.astype(np.float64)
    total, absolute, length = f.sum(axis=1), np.abs(f).sum(axis=1), np.sqrt((f * f).sum(axis=1))
    part = np.repeat(-float(1 << top) * total[:, None], len(c), axis=1)
    low, high = low.astype(np.float64), high.astype(np.float64)
    pairs = None
    for b in range(top, -1, -1):
        plane = ((u >> b) & 1).astype(np.float64)
        half = ((1 << b) - 1) / 2  # of the range of what is left of a component
        left = np.sqrt((((u & ((1 << b) - 1)) - half) ** 2).sum(axis=1)) * (1 + 1e-9)
        if pairs is None:
            part += (1 << b) * (f @ plane.T)
            middle = part + half * total[:, None]
            reach = np.minimum(half * absolute[:, None], length[:, None] * left[None, :])
            if best and len(c) >= best:
                sure = np.where(allowed, middle - reach, -np.inf)
                low = np.maximum(low, np.partition(sure, len(c) - best, axis=1)[:, len(c) - best] - 0.5)
            live = allowed & (middle + reach >= low[:, None] - 0.5) & (middle - reach <= high[:, None] + 0.5)
            if b == 0 or np.count_nonzero(live) <= SPARSE * live.size:
                pairs = np.nonzero(live)
                part = part[pairs]
        else:
            i, j = pairs
            part = part + (1 << b) * np.einsum("ij,ij->i", f[i], plane[j])
            middle = part + half * total[i]
            reach = np.minimum(half * absolute[i], length[i] * left[j])
            live = (middle + reach >= low[i] - 0.5) & (middle - reach <= high[i] + 0.5)
            pairs, part = (i[live], j[live]), part[live]
        if pairs is not None and not len(pairs[0]):
            break
    return pairs[0], pairs[1], part.astype(np.int64)


class Best:
    """The first few (score descending, id) of every key."""

    def __init__(self, keys: int, most: int):
        self.keys, self.most = keys, most
        self.key = self.score = self.id = np.zeros(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        by = np.lexsort((ids, -score, key))
        key = key[by]
        first = np.searchsorted(key, key)
        kept = np.arange(len(key)) - first < self.most
        self.key, self.score, self.id = key[kept], score[by][kept], ids[by][kept]

    def bar(self) -> np.ndarray:
        """The last score of every key that is full, below any score for the others."""
        out = np.full(self.keys, np.iinfo(np.int64).min // 4)
        last = np.searchsorted(self.key, np.arange(self.keys), side="right") - 1
        full = np.bincount(self.key, minlength=self.keys) >= self.most
        out[full] = self.score[last[full]]
        return out


def _table(*columns: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(columns, _FOUND, strict=True)], names=[n for n, _ in _FOUND])


def best_positives(anchors: pa.Table, rows: pa.Table, most: int) -> pa.Table:
    """Of two blocks: the first rows of every anchor's own label."""
    no, anchor_id, label, a = anchors["no"].to_numpy(), anchors["id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["vec"])
    ids, own, c = rows["id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["vec"])
    best = Best(len(no), most)
    for x in np.unique(label):
        of, there = np.flatnonzero(label == x), np.flatnonzero(own == x)
        for t in range(0, len(there), TILE):
            j = there[t : t + TILE]
            bar = best.bar()[of]
            p, q, score = living_pairs(a[of], c[j], bar, np.full(len(of), np.iinfo(np.int64).max // 4), anchor_id[of][:, None] != ids[j][None, :], most)
            best.add(of[p], score, ids[j][q])
    k = best.key
    zero = np.zeros(len(k), np.int64)
    return _table(no[k], anchor_id[k], zero, zero, zero, best.id, best.score)


def best_negatives(anchors: pa.Table, rows: pa.Table, most: int, percent: tuple[int, int]) -> pa.Table:
    """Of two blocks: for every positive of every anchor, the first rows of other labels within the percentages of its score."""
    no, anchor_id, label, a = anchors["no"].to_numpy(), anchors["id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["vec"])
    ids, own, c = rows["id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["vec"])
    listed = anchors["positives"].combine_chunks() if isinstance(anchors["positives"], pa.ChunkedArray) else anchors["positives"]
    size = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = listed.flatten()
    p_id, p_score = flat.field("id").to_numpy(zero_copy_only=False), flat.field("score").to_numpy(zero_copy_only=False)
    p_of = np.repeat(np.arange(len(no)), size)  # the anchor of a positive
    begin = np.cumsum(size) - size
    least, top = -((-percent[0] * p_score) // 100), percent[1] * p_score // 100
    best = Best(len(p_id), most)
    for t in range(0, len(ids), TILE):
        j = np.arange(t, min(t + TILE, len(ids)))
        bar = np.maximum(least, best.bar())
        bar = np.where(bar > top, np.iinfo(np.int64).max // 4, bar)  # an empty window
        of = np.flatnonzero(size > 0)
        low, high = np.minimum.reduceat(bar, begin[of]) if len(of) else bar[:0], np.maximum.reduceat(top, begin[of]) if len(of) else top[:0]
        p, q, score = living_pairs(a[of], c[j], low, high, (label[of][:, None] != own[j][None, :]) & (anchor_id[of][:, None] != ids[j][None, :]))
        n = size[of][p]
        pair = np.repeat(np.arange(len(p)), n)
        k = np.repeat(begin[of][p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        fit = (score[pair] >= bar[k]) & (score[pair] <= top[k])
        best.add(k[fit], score[pair][fit], ids[j][q][pair][fit])
    k = best.key
    return _table(no[p_of[k]], anchor_id[p_of[k]], k - begin[p_of[k]] + 1, p_id[k], p_score[k], best.id, best.score)


def _first(rows: DataFrame, most: int, *key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "other"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (id, label, vec of long) where anchor holds."""
    scratch = Scratch(rows.sparkSession, "negatives")
    small = F.size("vec") * F.pow(F.greatest(F.abs(F.coalesce(F.array_max("vec"), F.lit(0))), F.abs(F.coalesce(F.array_min("vec"), F.lit(0)))).cast("double"), 2) < 2.0**50
    rows = rows.select(F.col("id").cast("long").alias("id"), "label", F.col("vec").cast("array<long>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()) & small)
    rows = scratch.keep(rows.distinct(), "rows")
    labels = rows.schema["label"].dataType.simpleString()
    if labels not in ("tinyint", "smallint", "int", "bigint"):  # equal labels of other kinds have equal hashes of 64 bits
        rows = rows.withColumn("label", F.xxhash64("label"))
    anchors = scratch.keep(rows.where("anchor").drop("anchor").withColumn("no", F.monotonically_increasing_id()), "anchors")
    n_rows, n_anchors = rows.count(), anchors.count()
    across, down = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    block = lambda key, n: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.select("id", "label", "vec", block(("id", "label", "vec"), down).alias("j"), each(across).alias("i")).groupBy("i", "j")

    def meet(anchors: DataFrame, work) -> DataFrame:
        left = anchors.withColumn("i", block(("no",), across)).select("*", each(down).alias("j"))
        return left.groupBy("i", "j").cogroup(right).applyInArrow(work, FOUND)

    best = _first(meet(anchors, lambda a, r: best_positives(a, r, positives)), positives, "no")
    listed = best.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("other").alias("id"), "score"))).alias("positives"))
    ready = scratch.keep(anchors.join(listed, "no"), "ready")
    found = _first(meet(ready, lambda a, r: best_negatives(a, r, negatives, percent)), negatives, "no", "place")
    return found.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
