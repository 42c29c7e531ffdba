"""Top-k neighbours of vectors, for one query or for every vector."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..sources.shared import Tables


def top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows (id, vec) most like a query vector; of equal ones the lesser id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", F.round(cosine(F.col("vec"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


#: Pairs that are computed in double precision at once.
_EXACT = 1 << 16


def _pack(block_rows: int, prefix: str = ""):
    """Rows (id, vec) as one row (at, ids, vecs) of bytes for each block_rows of them, in the order they come; at numbers a task's blocks."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal at
            at += 1
            vec = pa.concat_arrays(rows["vec"].chunks).flatten().to_numpy(zero_copy_only=False)
            of = {"at": pa.array([at], pa.int64()), "ids": pa.array([rows["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "vecs": pa.array([vec.tobytes()], pa.binary())}
            return pa.RecordBatch.from_pydict({prefix + name: x for name, x in of.items()})

        left, at = None, -1
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            left = rows if left is None else pa.concat_tables([left, rows])
            while left.num_rows >= block_rows:
                yield block(left[:block_rows])
                left = left[block_rows:]
        if left is not None and left.num_rows:
            yield block(left)

    return apply


def _unpacked(ids: bytes, vecs: bytes, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, unit vectors, the same in single precision) of a block, without vectors that aren't finite."""
    id_ = np.frombuffer(ids, dtype="<i8")
    vec = np.frombuffer(vecs, dtype=kind).astype(np.float64).reshape(len(id_), -1)
    with np.errstate(invalid="ignore", over="ignore"):
        unit = vec / (np.linalg.norm(vec, axis=1, keepdims=True) + 1e-12)
    ok = np.isfinite(unit).all(axis=1)
    return id_[ok], unit[ok], unit[ok].astype(np.float32)


class _Best:
    """The k best others of each vector of a block so far, of equal scores the lesser id."""

    def __init__(self, block: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, above: float | None):
        self.ids, self.unit, self.single = block
        self.k, self.above = k, -np.inf if above is None else above
        self.score = np.full((len(self.ids), k), -np.inf)
        self.other = np.full((len(self.ids), k), np.iinfo(np.int64).max)
        # More than single precision and the rounding to six places can differ by.
        self.margin = 1e-6 + (self.unit.shape[1] + 8) * 2.0**-23

    def see(self, ids: np.ndarray, unit: np.ndarray, single: np.ndarray) -> None:
        """Products in single precision tell which pairs may be among the best; only these are computed exactly."""
        if not len(ids) or not len(self.ids):
            return
        score = self.single @ single.T
        floor = (np.maximum(self.score[:, -1], self.above) - self.margin).astype(np.float32)
        hit = score >= floor[:, None]
        if np.count_nonzero(hit) > 16 * hit.shape[0] * self.k and len(ids) > self.k:  # the first blocks: only the best of this one
            score[self.ids[:, None] == ids[None, :]] = -np.inf
            floor = np.maximum(floor, np.partition(score, -self.k, axis=1)[:, -self.k] - np.float32(2 * self.margin))
            hit = score >= floor[:, None]
        hits = np.flatnonzero(hit)
        for at in range(0, len(hits), _EXACT):
            self._add(*np.divmod(hits[at : at + _EXACT], len(ids)), ids, unit)

    def _add(self, row: np.ndarray, col: np.ndarray, ids: np.ndarray, unit: np.ndarray) -> None:
        # Nothing is more than 1: among equals only lesser ids are news.
        news = (self.ids[row] != ids[col]) & ((self.score[row, -1] < 1) | (ids[col] < self.other[row, -1]))
        row, col = row[news], col[news]
        score = np.round(np.einsum("ij,ij->i", self.unit[row], unit[col]), 6)
        last, other = self.score[row, -1], ids[col]
        news = (score > self.above) & ((score > last) | ((score == last) & (other < self.other[row, -1])))
        row, score, other = row[news], score[news], other[news]
        if not len(row):
            return
        changed = np.unique(row)
        row = np.concatenate([np.repeat(changed, self.k), row])
        score, other = np.concatenate([self.score[changed].ravel(), score]), np.concatenate([self.other[changed].ravel(), other])
        order = np.lexsort((other, -score, row))
        row, score, other = row[order], score[order], other[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        take = first[:, None] + np.arange(self.k)
        self.score[changed], self.other[changed] = score[take], other[take]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(np.isfinite(self.score))
        return self.ids[row], self.other[row, place], self.score[row, place]


def _best_of(k: int, above: float | None, kind: str):
    """Pairs of blocks (at, ids, vecs; own_at, own_ids, own_vecs), the own ones whole only beside the first block: the k best of what passed by for each own id."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, last, passing = {}, None, None
        for batch in batches:
            for r, (at, own) in enumerate(zip(batch["at"].to_pylist(), batch["own_at"].to_pylist(), strict=True)):
                if at != last:
                    last, passing = at, _unpacked(batch["ids"][r].as_py(), batch["vecs"][r].as_py(), kind)
                if own not in best:
                    best[own] = _Best(_unpacked(batch["own_ids"][r].as_py(), batch["own_vecs"][r].as_py(), kind), k, above)
                best[own].see(*passing)
        if not best:
            return
        id_, other, score = (np.concatenate(x) for x in zip(*(b.rows() for b in best.values()), strict=True))
        order = np.lexsort((other, -score, id_))  # rows of one id are ranked together
        id_, other, score = id_[order], other[order], score[order]
        first = np.flatnonzero(np.append(True, id_[1:] != id_[:-1])) if len(id_) else np.zeros(0, dtype=np.int64)
        rank = np.arange(1, len(id_) + 1) - np.repeat(first, np.diff(np.append(first, len(id_))))
        top = rank <= k
        yield pa.RecordBatch.from_pydict({"id": id_[top], "other": other[top], "score": score[top], "rank": rank[top].astype(np.int32)})

    return apply


#: Vectors that a task finds the neighbours of: at least about so many where there are fewer than 64 tasks, at most about so many blocks.
_OWN_ROWS, _OWN_BLOCKS = 1024, 4


def neighbours(vectors: DataFrame, k: int, *, above: float | None = None, block_rows: int = 4096, lazy: bool = False) -> DataFrame:
    """(id, other, score, rank): the k most similar others of every vector, of equal ones the lesser id; only scores above a bound, where one is given.

    Exact.  A task takes the vectors whose ids it is dealt and reads all others, packed into blocks
    of at most block_rows, so nothing is shuffled; only products and reads grow with pairs.
    The vectors and the result are written as tables.  lazy: neither is, for vectors that are
    cheap to read (a given table; every task reads them) and a result that is used once.
    Null and non-finite vectors have no neighbours.
    """
    kind, of = ("<f4", "float") if vectors.schema["vec"].dataType.elementType.typeName() == "float" else ("<f8", "double")
    rows = vectors.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vec").cast(f"array<{of}>").alias("vec"))
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession, "neighbours")
    if not lazy:
        rows = tables.keep(rows)
    n = rows.count()
    tasks = max(1, min(64, -(-n // _OWN_ROWS)), -(-n // (_OWN_BLOCKS * block_rows)))
    rows = rows.coalesce(1)  # each task reads it itself
    number = spark.range(0, tasks, 1, tasks).withColumnRenamed("id", "task").hint("shuffle_replicate_nl")
    own = rows.crossJoin(number).where(F.pmod(F.xxhash64("id"), F.lit(tasks)) == F.col("task")).select("id", "vec")
    own = own.mapInArrow(_pack(block_rows, "own_"), "own_at long, own_ids binary, own_vecs binary")
    pairs = rows.mapInArrow(_pack(block_rows), "at long, ids binary, vecs binary").crossJoin(own.hint("shuffle_replicate_nl"))
    once = lambda name: F.when(F.col("at") == 0, F.col(name)).alias(name)
    found = pairs.select("at", "ids", "vecs", "own_at", once("own_ids"), once("own_vecs")).mapInArrow(_best_of(k, above, kind), "id long, other long, score double, rank int")
    if not lazy:
        found = tables.keep(found)
        tables.delete(tables.count)
    return found


def _top_of(k: int):
    """Of a block of queries (query_id, vec) and one of vectors (id, vec): each query's k most similar."""

    def apply(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        q_id, ids = queries["query_id"].to_numpy(), vectors["id"].to_numpy()
        if not len(q_id) or not len(ids):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v = (np.array(t["vec"].to_pylist(), dtype=np.float64).reshape(t.num_rows, -1) for t in (queries, vectors))
        q, v = (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12) for x in (q, v))
        by_id = np.argsort(ids, kind="stable")
        score = np.round(q @ v[by_id].T, 6)
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(q_id)), best.shape[1])
        return pa.table({"query_id": q_id[row], "id": ids[by_id][best.ravel()], "score": score[row, best.ravel()]})

    return apply


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _plain(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col("vec").isNotNull()).select(F.col(key).cast("long").alias(key), F.col("vec").cast("array<double>").alias("vec"))


def _split(size: Column, rows: int) -> Column:
    return F.greatest(F.ceil(size / rows), F.lit(1)).cast("int")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, block_rows: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): the k vectors (id, vec) most similar to each query (query_id, vec), of equal ones the lesser id.  Exact.

    A task multiplies a block of queries and a block of vectors.
    """
    queries, vectors = _plain(queries, "query_id"), _plain(vectors, "id")
    n, m = (max(1, -(-x.count() // block_rows)) for x in (queries, vectors))
    own = lambda key, blocks: F.pmod(F.xxhash64(key, "vec"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.withColumn("i", own("query_id", n)).select("*", each(m).alias("j"))
    right = vectors.withColumn("j", own("id", m)).select("*", each(n).alias("i"))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_top_of(k), "query_id long, id long, score double")
    return _first(found, k)


@dataclass(frozen=True)
class InvertedLists:
    """Vectors dealt to the lists of their nearest centres; a query looks into the lists of its own nearest ones.

    Centres and the number of lists to look into are fitted on at most `sample` vectors, picked by
    hash: so many that on the sample the recall asked for is reached.  All vectors are listed.
    """

    centres: np.ndarray
    probes: int
    recall: float

    @classmethod
    def fit(cls, vectors: DataFrame, *, sample: int = 8192, recall: float = 0.95, k: int = 8, rounds: int = 8) -> InvertedLists:
        rows = _plain(vectors, "id")
        share = min(1.0, sample / max(rows.count(), 1))
        picked = rows.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("id", "vec")).limit(sample)
        x = np.array([r["vec"] for r in picked.select("vec").collect()], dtype=np.float64)
        if not len(x):
            return cls(np.zeros((0, 0)), 1, 1.0)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
        lists = max(1, int(len(x) ** 0.5 / 2))
        centres = x[np.linspace(0, len(x) - 1, lists).astype(int)]
        for _ in range(rounds):
            of = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, of, x)
            full = np.bincount(of, minlength=lists) > 0
            centres = np.where(full[:, None], sums, centres)
            centres = centres / (np.linalg.norm(centres, axis=1, keepdims=True) + 1e-12)
        of = (x @ centres.T).argmax(axis=1)
        asked = x[:: max(1, len(x) // 256)]
        score = asked @ x.T
        top = np.argsort(-score, axis=1, kind="stable")[:, 1 : k + 1]  # the first is the query itself
        if not top.size:
            return cls(centres, 1, 1.0)
        place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
        needed = place[np.arange(len(asked))[:, None], of[top]]
        reached = [(needed <= p).mean() for p in range(lists)]
        probes = next((p + 1 for p, r in enumerate(reached) if r >= recall), lists)
        return cls(centres, probes, float(reached[probes - 1]))

    def _lists(self, most: int):
        centres = self.centres

        @F.pandas_udf("array<int>")
        def lists(vec: pd.Series) -> pd.Series:
            x = np.array(vec.tolist(), dtype=np.float64).reshape(len(vec), -1)
            return pd.Series(list(np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :most].astype(np.int32)))

        return lists

    def search(self, queries: DataFrame, vectors: DataFrame, k: int, *, block_rows: int = 4096) -> DataFrame:
        """(query_id, id, score, rank) as nearest(), among the vectors of the lists that a query looks into; scores are exact.

        Long lists are cut into blocks, so a list that holds very many vectors is many tasks.
        """
        queries, vectors = _plain(queries, "query_id"), _plain(vectors, "id")
        if not len(self.centres):
            return nearest(queries, vectors, k)
        listed = vectors.withColumn("list", self._lists(1)("vec")[0])
        parts = listed.groupBy("list").agg(_split(F.count("*"), block_rows).alias("parts"))  # a row for each list
        right = listed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("parts")).cast("int")).drop("parts")
        asked = queries.withColumn("list", F.explode(self._lists(self.probes)("vec"))).join(F.broadcast(parts), "list")
        left = asked.select("query_id", "vec", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        many = _split(F.count("*"), block_rows)
        groups = left.groupBy("list").agg(many.alias("groups"))
        left = left.join(F.broadcast(groups), "list").withColumn("group", F.pmod(F.xxhash64("query_id", "vec"), F.col("groups")).cast("int")).drop("groups")
        right = right.join(F.broadcast(groups), "list").select("id", "vec", "list", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
        by = ["list", "part", "group"]
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_top_of(k), "query_id long, id long, score double")
        return _first(found, k)


def semantic_edges(near: DataFrame, threshold: float) -> DataFrame:
    """Neighbours above the threshold (strictly) as edges src, dst, weight: score less threshold; mutual ones stand twice."""
    return near.where(F.col("score") > threshold).select(F.col("id").alias("src"), F.col("other").alias("dst"), (F.col("score") - threshold).alias("weight"))
