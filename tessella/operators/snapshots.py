"""Incremental work: what changed between two snapshots, and what can be kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, status): added, removed or changed, by hash; unchanged files don't appear."""
    both = current.select("file", F.col("hash").alias("now")).join(manifest.select("file", F.col("hash").alias("was")), "file", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed")
    return both.select("file", status.alias("status")).where("status IS NOT NULL")


def scoped(changes: DataFrame, files: DataFrame) -> DataFrame:
    return changes.join(files.select("file"), "file", "left_semi")


def reuse(entities: DataFrame, known: DataFrame) -> DataFrame:
    """entities with the summary of a known entity of the same id and hash, if it has one; the rest need work."""
    prior = known.where("length(trim(summary)) > 0").select("node_id", "code_hash", F.col("summary").alias("reused"))
    return entities.join(prior, ["node_id", "code_hash"], "left").withColumn("needs_work", F.col("reused").isNull())


def cascade(rows: DataFrame, changes: DataFrame, key: str = "file") -> DataFrame:
    """rows without those of removed or changed files."""
    return rows.join(changes.where("status IN ('removed', 'changed')").select(F.col("file").alias(key)), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old rows whose key isn't in new, and all of new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def last_by(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), ordinal).alias("r")).select("r.*")


def manifest(current: DataFrame, entities: DataFrame) -> DataFrame:
    """(file, hash, node_ids): every current file, with its entities' ids in order, comma-joined."""
    ids = entities.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("node_ids"))
    return current.select("file", "hash").join(ids, "file", "left").withColumn("node_ids", F.coalesce("node_ids", F.lit("")))


def unchanged_concepts(now: DataFrame, before: DataFrame, touched: DataFrame) -> DataFrame:
    """Concepts (concept_id, node_id rows) whose members are the same as before and none of them touched (node_id)."""
    a, b = (rows.select("concept_id", "node_id").distinct() for rows in (now, before))
    sized = lambda rows, name: rows.groupBy("concept_id").agg(F.count("*").alias(name))
    shared = sized(a.join(b, ["concept_id", "node_id"], "left_semi"), "n")
    same = shared.join(sized(a, "n_a"), "concept_id").join(sized(b, "n_b"), "concept_id").where("n = n_a AND n = n_b").select("concept_id")
    hit = now.join(touched.select("node_id"), "node_id", "left_semi").select("concept_id").distinct()
    return same.join(hit, "concept_id", "left_anti")


def stale_embeddings(concepts: DataFrame, embedded: DataFrame) -> DataFrame:
    """(concept_id, action): embed what has no embedding, drop what is retired."""
    new = concepts.select("concept_id").join(embedded, "concept_id", "left_anti").withColumn("action", F.lit("embed"))
    gone = embedded.select("concept_id").join(concepts, "concept_id", "left_anti").withColumn("action", F.lit("drop"))
    return new.unionByName(gone)


def touched(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Changed nodes (node_id) and all that an edge ties to them."""
    to = edges.join(changed, edges["src"] == changed["node_id"], "left_semi").select(F.col("dst").alias("node_id"))
    fro = edges.join(changed, edges["dst"] == changed["node_id"], "left_semi").select(F.col("src").alias("node_id"))
    return changed.select("node_id").unionAll(to).unionAll(fro).distinct()


def progress(items: DataFrame) -> DataFrame:
    """One row of counts over (ordinal, status, error): total, done, failed, whole percent, first error."""
    return items.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.floor(100 * F.count_if(F.col("status").isin("done", "failed")) / F.nullif(F.count("*"), F.lit(0))), F.lit(100)).cast("long").alias("percent"),
        F.min_by("error", F.when(F.col("status") == "failed", F.col("ordinal"))).alias("first_error"),
    )
