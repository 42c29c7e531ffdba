"""Model calls as a pluggable function over rows, with a deterministic stand-in."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..sources.shared import Tables


class Enricher(Protocol):
    def complete(self, system: str, prompt: str) -> str: ...


class Offline:
    """Answers with a JSON object made of the prompt alone."""

    def complete(self, system: str, prompt: str) -> str:
        text = " ".join(prompt.split())
        return json.dumps({"tag": hashlib.sha1(text.encode()).hexdigest()[:8], "summary": text[:280]})


_BACKENDS: dict[str, Callable[[], Enricher]] = {"offline": Offline}


def register(name: str, make: Callable[[], Enricher]) -> None:
    _BACKENDS[name] = make


def build(name: str) -> Enricher:
    if name not in _BACKENDS:
        raise ValueError(f"unknown backend {name!r}")
    return _BACKENDS[name]()


def _parse(answer: str) -> dict:
    start, end = answer.find("{"), answer.rfind("}")
    got = json.loads(answer[start : end + 1])
    if not isinstance(got, dict):
        raise ValueError("not an object")
    return got


def _answer(backend: Enricher, system: str, prompt: str, attempts: int) -> tuple[str, str, str | None]:
    """(tag, summary, error) of one call; an answer that isn't an object is asked for again."""
    error = None
    for k in range(attempts):
        try:
            got = _parse(backend.complete(system + (" Answer with a JSON object only." if k else ""), prompt))
            return str(got.get("tag") or ""), str(got.get("summary") or ""), None
        except Exception as e:  # noqa: BLE001  any failure of a backend
            error = f"{type(e).__name__}: {e}"
    return "", "", error


def enrich(rows: DataFrame, prompt: Column, make: Callable[[], Enricher] = Offline, *, system: str = "", attempts: int = 2, workers: int = 1) -> DataFrame:
    """rows with answer (tag, summary, error): one call a row, in Arrow batches; a failed call leaves an error, not a failed job.

    A task has up to `workers` calls under way at once; a backend that isn't safe for that wants 1.
    """

    @F.pandas_udf("tag string, summary string, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        backend = make()
        with ThreadPoolExecutor(workers) as pool:
            for prompts in batches:
                out = list(pool.map(lambda p: _answer(backend, system, p or "", attempts), prompts))
                yield pd.DataFrame(out, columns=["tag", "summary", "error"])

    return rows.withColumn("answer", call(prompt))


#: Calls under way at once, and calls between two checkpoints of a long job.
WORKERS, CHUNK = 6, 5


class ResultLog:
    """Answers by (node_id, code_hash) in an append-only folder, which a long job fills as its tasks end."""

    SCHEMA = "node_id string, code_hash string, tag string, summary string, error string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All rows ever written; a job that was stopped may have left some."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def answers(self) -> DataFrame:
        """One row for each key that has an answer without an error."""
        done = self.rows().where("error IS NULL")
        return done.groupBy("node_id", "code_hash").agg(F.min(F.struct("tag", "summary")).alias("a")).select("node_id", "code_hash", "a.*")

    def fill(self, rows: DataFrame, prompt: Column, make: Callable[[], Enricher] = Offline, *, chunk: int = CHUNK, workers: int = WORKERS, system: str = "") -> None:
        """Calls the backend for the rows (node_id, code_hash) without an answer, `chunk` of them in a task.

        A task's results are in the log once it ends, whatever becomes of the job; so a job that is
        started again repeats only the tasks that hadn't ended, and calls that failed.
        """
        todo = rows.select("node_id", "code_hash", prompt.alias("prompt")).dropDuplicates(["node_id", "code_hash"]).join(self.answers(), ["node_id", "code_hash"], "left_anti")
        with Tables(self.spark, "calls") as tables:
            todo = tables.keep(todo)
            parts = max(1, -(-todo.count() // chunk))
            called = enrich(todo.repartition(parts, "node_id", "code_hash"), F.col("prompt"), make, system=system, workers=workers)
            out = called.select("node_id", "code_hash", "answer.tag", "answer.summary", "answer.error")
            # Version 2 of the committer moves a task's file to its place when the task ends, not when the job does.
            out.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path)


def fallback_summary(transcript: Column) -> Column:
    return snippet(transcript)


def embedding_text(summary: Column, signature: Column, node_id: Column) -> Column:
    joined = F.trim(F.concat_ws("\n", summary, signature))
    return F.when(F.length(joined) > 0, joined).otherwise(node_id)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """Unit vectors of hashed words, the offline stand-in for an embedding model."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float]:
            v = np.zeros(size)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % size] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return texts.map(one, na_action=None)

    return embed(text)
