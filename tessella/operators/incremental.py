"""A code graph (files, entities, edges, embeddings) that follows changes of files without a rebuild."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.code import parse
from ..sources.shared import Tables
from . import snapshots
from .enrich import embedding_text, hashed_embedding
from .graph import contains_edges, named_edges, neighbourhood, structural_edges

#: Gives entities their summary; the second table holds known entities (node_id, code_hash, summary), or is None.
Digest = Callable[[DataFrame, DataFrame | None], DataFrame]


def without_summaries(entities: DataFrame, known: DataFrame | None) -> DataFrame:
    """The digest of a graph without a model: summaries of unchanged code stay, others are empty."""
    if known is None:
        return entities.withColumn("summary", F.lit(""))
    rows = snapshots.reuse(entities, known)
    return rows.withColumn("summary", F.coalesce("reused", F.lit(""))).drop("reused", "needs_work")


@dataclass(frozen=True)
class CodeGraph:
    """manifest (file, hash, node_ids), entities with their summary, edges (src, dst, type), embeddings (node_id, vec)."""

    manifest: DataFrame
    entities: DataFrame
    edges: DataFrame
    embeddings: DataFrame

    TABLES = ("entities", "edges", "embeddings", "manifest")

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in self.TABLES}


def embedded(entities: DataFrame, size: int = 64) -> DataFrame:
    text = embedding_text(F.col("summary"), F.col("signature"), F.col("node_id"))
    return entities.select("node_id", hashed_embedding(text, size).alias("vec"))


def build(files: DataFrame, *, digest: Digest = without_summaries, tables: Tables | None = None) -> CodeGraph:
    """The graph of all files (file, content, hash); the parsed entities are written once, as every other table needs them."""
    tables = tables or Tables(files.sparkSession, "graph")
    entities = tables.keep(digest(parse(files), None))
    return CodeGraph(snapshots.manifest(files, entities), entities, structural_edges(entities), embedded(entities))


def changed_edges(edges: DataFrame, kept: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges of kept and fresh entities together, from those of kept and gone ones.

    An edge depends on its two entities only.  So edges that touch a gone entity go; what is
    new ties a fresh entity to any, or a kept one to a fresh one.  Only names that fresh
    entities define or use are joined, kept entities among themselves never.
    """
    lost = gone.select(F.col("node_id").alias("lost"))
    left = edges.join(lost, F.col("src") == F.col("lost"), "left_anti").join(lost, F.col("dst") == F.col("lost"), "left_anti")
    out = named_edges(fresh, kept.select(*fresh.columns).unionAll(fresh))
    back = named_edges(kept, fresh)
    return left.unionAll(contains_edges(fresh)).unionAll(out).unionAll(back)


@dataclass(frozen=True)
class Synced:
    """The graph after a sync, the files' changes (file, status), and the nodes (node_id) near a change."""

    graph: CodeGraph
    changes: DataFrame
    touched: DataFrame


def sync(graph: CodeGraph, current: DataFrame, *, scope: DataFrame | None = None, digest: Digest = without_summaries, hops: int = 2, tables: Tables | None = None) -> Synced:
    """The graph of the current files (file, content, hash), from the graph of the files before.

    Only added and changed files are parsed, and only their entities embedded; what leaves with
    removed and changed files takes its edges and embeddings along.  With a scope (file), files
    outside it stay as they were.  Touched are fresh entities, what an edge tied to gone ones, and
    what is within some hops of these.  The result equals build() of the same files.
    """
    tables = tables or Tables(current.sparkSession, "sync")
    changes = snapshots.diff(current, graph.manifest)
    if scope is not None:
        changes = snapshots.scoped(changes, scope)
    changes = tables.keep(changes)
    work = changes.where("status <> 'removed'").select("file")
    lost = changes.where("status <> 'added'").select("file")
    gone = tables.keep(graph.entities.join(lost, "file", "left_semi").select("node_id", "code_hash", "summary"))
    kept = snapshots.cascade(graph.entities, changes)
    fresh = tables.keep(digest(parse(current.join(work, "file", "left_semi")), gone))
    entities = kept.unionByName(fresh)
    edges = tables.keep(changed_edges(graph.edges, kept, fresh, gone))
    embeddings = graph.embeddings.join(gone.select("node_id"), "node_id", "left_anti").unionByName(embedded(fresh))
    old = graph.manifest.join(lost, "file", "left_anti")
    new = snapshots.manifest(current.join(work, "file", "left_semi"), fresh)
    near = snapshots.touched(gone, graph.edges).select(F.col("node_id").alias("v")).unionAll(fresh.select("node_id")).distinct()
    near = neighbourhood(tables.keep(near), edges, hops).join(entities.select(F.col("node_id").alias("v")), "v", "left_semi")
    return Synced(CodeGraph(old.unionByName(new), entities, edges, embeddings), changes, near.withColumnRenamed("v", "node_id"))
