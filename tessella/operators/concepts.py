"""Concepts: communities of entities with stable ids and digests, of which only what changed is digested again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Tables
from . import snapshots
from .enrich import Enricher, Offline, enrich
from .graph import identify, next_number

#: Fixed value: so many members of a concept, in the order of their ids, stand in its prompt.
MOST_MEMBERS = 40


def prompts(members: DataFrame, entities: DataFrame, *, most: int = MOST_MEMBERS) -> DataFrame:
    """(concept_id, prompt): a line "tag: summary" for each of a concept's first members (concept_id, node_id)."""
    rank = F.row_number().over(Window.partitionBy("concept_id").orderBy("node_id"))
    first = members.withColumn("m", rank).where(F.col("m") <= most)
    line = F.concat(F.coalesce("tag", F.lit("")), F.lit(": "), F.coalesce("summary", F.lit("")))
    lines = first.join(entities.select("node_id", line.alias("line")), "node_id", "left")
    return lines.groupBy("concept_id").agg(F.coalesce(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY m)"), F.lit("")).alias("prompt"))


@dataclass(frozen=True)
class Reclustered:
    """concepts (concept_id, tag, summary, split_from, merged_from, called, error) and their members (concept_id, node_id)."""

    concepts: DataFrame
    members: DataFrame


def recluster(
    communities: DataFrame, entities: DataFrame, old_concepts: DataFrame, old_members: DataFrame, touched: DataFrame | None, *, make: Callable[[], Enricher] = Offline, threshold: float = 0.5, tables: Tables | None = None
) -> Reclustered:
    """Concepts of new communities (community, node_id), from the concepts before (concept_id, tag, summary) and their members.

    A community that matches one concept and no other keeps its id.  A concept with its id and
    members as before and none of them touched (node_id; None: all are) keeps its tag and summary
    verbatim; only the others are digested, one call each.
    """
    tables = tables or Tables(communities.sparkSession, "recluster")
    ids = tables.keep(identify(communities, old_members, threshold=threshold, next_number=next_number(old_concepts).first()["next"]))
    members = tables.keep(communities.join(ids, "community").select("concept_id", "node_id"))
    none = members.limit(0).select("concept_id")
    same = none if touched is None else snapshots.unchanged_concepts(members, old_members, touched)
    lineage = ids.select("concept_id", "split_from", "merged_from")
    kept = tables.keep(lineage.join(same, "concept_id").join(old_concepts.select("concept_id", "tag", "summary"), "concept_id"))
    fresh = members.join(kept.select("concept_id"), "concept_id", "left_anti")
    told = tables.keep(enrich(prompts(fresh, entities), F.col("prompt"), make).select("concept_id", "answer.*"))
    new = lineage.join(told, "concept_id").select("concept_id", "tag", "summary", "split_from", "merged_from", F.lit(True).alias("called"), "error")
    return Reclustered(kept.select("concept_id", "tag", "summary", "split_from", "merged_from", F.lit(False).alias("called"), F.lit(None).cast("string").alias("error")).unionByName(new), members)
