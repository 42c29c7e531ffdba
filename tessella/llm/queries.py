"""The registered queries of this subpackage: thin contracts over its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, fingerprints, hard_negatives, jaccard_join, language_id, line_dedup, packing, periodic_runs, pii, suffix_dedup, token_counts, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(F.coalesce(~language_id.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull(), F.lit(False))))
    rows = docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "text")
    return language_id.predict(rows, model).drop("text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.annotate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("r.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.col("kept").alias("text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=400)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) of which a tenth repeats itself to its end; their words are joined by one space."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    parts = docs.withColumn("w", F.when(chosen, F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != ""))).withColumn("g", F.floor(h / 10)).withColumn("n", F.size("w"))
    parts = parts.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    parts = parts.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    words = F.concat(F.slice("w", 1, F.col("a")), F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), 1, F.col("n") - F.col("a")))
    return parts.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.annotate(with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text")), least=12).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, label = F.col("vec_id"), F.col("label")
    moved = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = _table(spark, sf_dir, "embeddings").select(key.alias("id"), moved.alias("label"), hard_negatives.quantized(F.col("embedding"), 256).alias("vec"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0, positives=5, negatives=5, percent=(80, 100))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    out = byte_bpe.decode(coded.select("doc_id", "ids"), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_token_counts, op4_decontaminate, op5_fingerprints, op6_suffix_dedup, op7_pii, op8_url_filter, op9_jaccard_join, op10_best_fit_packing, op11_periodic_runs, op12_hard_negatives, op13_byte_bpe)}

OP2_SQL = """
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
windows AS (SELECT doc_id, a, unnest(range(0, len(a) - 2)) AS pos FROM lines WHERE len(a) >= 3),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a[pos + 1], a[pos + 2], a[pos + 3] ORDER BY doc_id, pos) AS rn
  FROM windows),
covered AS (SELECT DISTINCT doc_id, pos + j AS i FROM ranked, (VALUES (0), (1), (2)) t(j) WHERE rn > 1),
numbered AS (SELECT doc_id, unnest(range(0, len(a))) AS i, unnest(a) AS line FROM lines),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text
  FROM numbered ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(l.a), 0) AS n_lines, coalesce(g.n, 0) AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM lines l LEFT JOIN kept k USING (doc_id) LEFT JOIN gone g USING (doc_id)
"""

OP12_SQL = """
WITH ok AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM ok a JOIN ok b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

#: The others are tested against brute force, the library or held-out rows in tests/llm.
ORACLES: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op12_hard_negatives": OP12_SQL}
