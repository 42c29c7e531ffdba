"""The corpus pipeline: language ID, line dedup, near copies, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from tessella.llm.common import Scratch, free_name, quoted

#: A posterior below this (chance is a quarter for four languages) counts as no language.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the table's own labels; "und" and undecided ones go.

    Null and empty texts, and those without a letter, are "und" and go; without any label all go.
    Repeated rows are judged alike; columns stay as they are, whatever their names.
    """
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    known = language_id.predict(docs, language_id.fit(docs), out_lang=lang, out_score=score)
    return known.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; a document of which nothing is left goes.

    n_chars follows the text.  Null texts and texts of fewer than three lines stay as they are;
    rows of equal id and text count as one document and are cut alike.
    """
    rows = line_dedup.annotate(docs).where("n_removed = 0 or n_removed < n_lines")
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return rows.select(*[changed.get(c, F.col(f"r.{quoted(c)}")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (word five-grams, similarity 0.8): the one with the least doc_id.

    Blank and null texts are in no class and stay; of rows of equal id and text one stays, the
    least in the order of the other columns.
    """
    return jaccard_join.representatives(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and blank texts hold none, and items without words are in none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 tokens; a null or empty text is its separator alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("pack", pack)]

#: Learned and iterative stages aren't SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            if k > 1:
                scratch.drop(STAGES[k - 1][0])
    return docs
