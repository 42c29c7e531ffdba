"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting reads a bounded sample of labelled rows (at most about ``rows_per_lang`` of each
language, picked by a hash of the id; rarer languages are used whole).  Counts are
summed on the executors; the driver receives one count per language and bucket, so
what is collected and broadcast is bounded by ``max_langs * buckets`` cells whatever
the input size.  Prediction is a narrow pass: each block of texts becomes a sparse
incidence of hashed n-grams, and the broadcast log-probability matrix is gathered and
summed per row in numpy.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with
no labelled row at all every text is ``und``; ties go to the first language in
ascending order; repeated rows are predicted alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .common import map_rows, trimmed

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKET_BITS = 16
#: Characters handled at once.
BLOCK_CHARS = 1 << 18


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: One row for each language; the last bucket is empty and stands for n-grams that do not exist.
    log_prob: np.ndarray
    log_prior: np.ndarray


def _blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    i, size = 0, 0
    for j, t in enumerate(texts):
        n = len(t) if t else 0
        if j > i and size + n > most:
            yield i, j
            i, size = j, 0
        size += n
    if len(texts) > i:
        yield i, len(texts)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def hashed_ngrams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of the n-gram at each character (or the empty bucket), and the rows' offsets."""
    low = [t.lower() if t else "" for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in low], out=offsets[1:])
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(code))
    out = []
    h = np.zeros(len(code), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros_like(code)
        shifted[: len(code) - n + 1] = code[n - 1 :] if n > 1 else code
        h = (h + shifted) * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            bucket = ((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
            bucket[left < n] = 1 << BUCKET_BITS
            out.append(bucket)
    return out, offsets


def _counter(langs: tuple[str, ...]):
    index = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << BUCKET_BITS) + 1
        total = np.zeros((len(langs), size), dtype=np.int64)
        for b in batches:
            texts, lang = b.column(0).to_pylist(), b.column(1).to_pylist()
            order = sorted(range(len(texts)), key=lambda k: index[lang[k]])
            texts, lang = [texts[k] for k in order], [index[lang[k]] for k in order]
            for i, j in _blocks(texts):
                grams, offsets = hashed_ngrams(texts[i:j])
                row = np.repeat(np.array(lang[i:j]), np.diff(offsets))
                for g in grams:
                    for k in set(lang[i:j]):
                        total[k] += np.bincount(g[row == k], minlength=size)
        lang_id, bucket = np.nonzero(total[:, :-1])
        for i in range(0, len(lang_id), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(lang_id[part].astype(np.int32)), pa.array(bucket[part].astype(np.int32)), pa.array(total[lang_id[part], bucket[part]])], names=["k", "bucket", "n"])

    return count


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_lang: int = 4000, max_langs: int = 64, smoothing: float = 0.05) -> Model:
    """Fits on a sample of at most about rows_per_lang rows of each language; more than max_langs languages are an error."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k"))
    seen = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy("l").limit(max_langs + 1).collect()
    if len(seen) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs, which bounds the broadcast matrix")
    langs = tuple(r["l"] for r in seen)
    size = (1 << BUCKET_BITS) + 1
    if not langs:
        return Model((), np.zeros((0, size), np.float32), np.zeros(0))
    share = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(1.0)
    for r in seen:
        if r["n"] > rows_per_lang:
            wanted = F.when(F.col("l") == r["l"], rows_per_lang / r["n"]).otherwise(wanted)
    counts = rows.where(share < wanted).select("t", "l").mapInArrow(trimmed(_counter(langs)), "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(langs), size), smoothing)
    np.add.at(table, (counts["k"].to_numpy(), counts["bucket"].to_numpy()), counts["n"].to_numpy())
    log_prob = np.log(table) - np.log(table[:, :-1].sum(axis=1, keepdims=True))
    log_prob[:, -1] = 0
    n = np.array([r["n"] for r in seen], dtype=float)
    return Model(langs, log_prob.astype(np.float32), np.log(n / n.sum()))


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and posterior probability of each text."""
    pred, prob = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return pred, prob
    for i, j in _blocks(texts):
        grams, offsets = hashed_ngrams(texts[i:j])
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            continue
        total = np.tile(model.log_prior, (len(full), 1))
        for k in range(len(model.langs)):
            for g in grams:
                total[:, k] += np.add.reduceat(model.log_prob[k][g], offsets[full], dtype=np.float64)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        for row, k, x in zip(full, best, p[np.arange(len(full)), best], strict=True):
            if has_letter(texts[i + row]):
                pred[i + row], prob[i + row] = model.langs[k], min(1.0, float(x))
    return pred, prob


def predict(docs: DataFrame, model: Model, *, text: str = "text", out_lang: str = "lang_pred", out_score: str = "score") -> DataFrame:
    """All columns of docs, with the prediction in two more (replacing columns of these names)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(out_lang, out_score)
    at = kept.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                pred, prob = score(held.value, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(prob)], names=[*part.schema.names, out_lang, out_score])

    return map_rows(kept, trimmed(apply), (StructField(out_lang, StringType()), StructField(out_score, DoubleType())))


def held_out(key: Column) -> Column:
    """Rows kept from fitting: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the labelled rows that are not held out and predicts every row of docs."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))
    return predict(docs, fit(docs.where(out)))
