"""Entity graphs: name resolution, weights, components, neighbourhoods, communities and their identities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.shared import Tables, ready_for_checkpoints


def contains_edges(entities: DataFrame) -> DataFrame:
    """Edges (src, dst, type) from the entity that a qualified name ends in to its members, in one file."""
    qual = F.substring_index("node_id", "::", -1)
    parent = F.concat("file", F.lit("::"), F.regexp_replace(qual, r"\.[^.]*$", ""))
    owned = entities.where(qual.contains(".")).select(parent.alias("src"), F.col("node_id").alias("dst"))
    return owned.join(entities.select(F.col("node_id").alias("src")), "src", "left_semi").select("src", "dst", F.lit("contains").alias("type"))


def named_edges(users: DataFrame, defined: DataFrame) -> DataFrame:
    """Edges (src, dst, type) by name from users to the entities in defined: calls (not of oneself) and inherits (of classes); repeats are kept."""
    target = defined.select("name", F.col("node_id").alias("dst"), F.col("kind").alias("target_kind"))
    called = users.select(F.col("node_id").alias("src"), F.explode("calls").alias("name"), F.lit("calls").alias("type"))
    based = users.where("kind = 'class'").select(F.col("node_id").alias("src"), F.explode("bases").alias("name"), F.lit("inherits").alias("type"))
    found = called.unionAll(based).join(target, "name")
    return found.where("(type = 'calls' AND src <> dst) OR (type = 'inherits' AND target_kind = 'class')").select("src", "dst", "type")


def structural_edges(entities: DataFrame) -> DataFrame:
    """Edges (src, dst, type) of entities by names: contains, calls and inherits; repeats are kept."""
    return contains_edges(entities).unionAll(named_edges(entities, entities))


def undirected_weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: weights of both directions together; loops go."""
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.agg(F.sum("weight").alias("weight"))


#: Pages of a block: two blocks make a matrix of at most about 2048 x 2048 counts, 16 MB.
BLOCK_PAGES = 2048


def _product(key: tuple, table: pa.Table) -> pa.Table:
    """Rows (block, page_id, target) of two blocks, or of one with itself: pairs of pages and the targets they share."""
    i, j = (k.as_py() for k in key)
    block = table["block"].to_numpy()
    page, target = table["page_id"].to_numpy(), table["target"].combine_chunks().dictionary_encode().indices.to_numpy()
    sides = []
    for own in (i, j):
        at = block == own
        pages, row = np.unique(page[at], return_inverse=True)
        o = np.argsort(target[at], kind="stable")
        sides.append((pages, row[o], target[at][o]))
    (left, lr, lt), (right, rr, rt) = sides
    count = np.zeros((len(left), len(right)), dtype=np.int32)
    targets, start = np.unique(lt, return_index=True)
    ends = np.append(start[1:], len(lt))
    r0, r1 = np.searchsorted(rt, targets, side="left"), np.searchsorted(rt, targets, side="right")
    for k in np.flatnonzero(r1 > r0):
        count[np.ix_(lr[start[k] : ends[k]], rr[r0[k] : r1[k]])] += 1
    if i == j:
        count = np.triu(count, 1)
    x, y = np.nonzero(count)
    a, b = left[x], right[y]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "weight": count[x, y].astype(np.int64)})


def shared_targets(rows: DataFrame, *, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """(a, b, weight) with a < b: pairs of pages and how many targets they share; rows are (page_id, target).

    The product of the page by target matrix with its transpose, by pairs of blocks of pages.
    A target that many pages name is spread over all tasks, and a pair is counted in one task,
    so no pair is shuffled.
    """
    rows = rows.where(F.col("page_id").isNotNull() & F.col("target").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), "target").distinct()
    n = rows.agg(F.approx_count_distinct("page_id")).first()[0]
    blocks = max(16, -(-n // block_pages))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("page_id"), F.lit(blocks)).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "page_id", "target")
    return dealt.groupBy("i", "j").applyInArrow(_product, "a long, b long, weight long")


def hybrid_weights(structural: DataFrame, semantic: DataFrame, *, structural_weight: float = 1.0, similarity_weight: float = 1.0) -> DataFrame:
    """Structural edges (src, dst), each of one weight, and semantic edges (src, dst, weight) as one weighted graph."""
    one = structural.select("src", "dst", F.lit(structural_weight).alias("weight"))
    return undirected_weights(one.unionByName(semantic.withColumn("weight", F.col("weight") * similarity_weight)))


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(v, root): the least vertex of each vertex's component (edges a, b), by minimum labels, which a root takes from all its vertices, and pointer jumping.

    Every round is a table (one of tables, if they are given), deleted when the next is there.  A checkpoint would keep the size that Spark
    estimated for its plan, which joins multiply from round to round where no adaptive execution corrects it.
    """
    tables = tables or Tables(edges.sparkSession, "components")
    both = tables.keep(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    first = tables.count
    labels = tables.keep(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("m"))
        seen = Observation()
        met = labels.join(near, "v").select("v", "root", "m")
        # what any vertex of a root meets counts for all of them
        offers = labels.select(F.col("v").alias("root"), F.col("root").alias("up")).unionAll(met.select("root", F.col("m").alias("up"))).groupBy("root").agg(F.min("up").alias("up"))
        step = met.join(offers, "root").select("v", F.col("root").alias("old"), F.least("root", "m", "up").alias("root"))
        labels = tables.keep(step.observe(seen, F.count_if(F.col("old") != F.col("root")).alias("changed"))).select("v", "root")
        tables.delete(tables.count, first + 1)
        if not seen.get["changed"]:
            tables.delete(first + 1, first)
            return labels


def numbered(rows: DataFrame, order: list, tables: Tables) -> DataFrame:
    """rows with their number from 0 in an order: sorted in ranges, each range's numbers start where those before it end."""
    placed = tables.keep(rows.orderBy(*order).withColumn("number", F.monotonically_increasing_id()))
    part = F.shiftright("number", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("before"))
    place = F.col("number").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(starts, "part").withColumn("number", F.col("before") + place).drop("part", "before")


def neighbourhood(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Vertices (v) within some hops of the seeds (v), in either direction."""
    reached = seeds.select("v").distinct()
    for _ in range(hops):
        near = [edges.join(reached, F.col(k) == F.col("v"), "left_semi").select(F.col(other).alias("v")) for k, other in (("src", "dst"), ("dst", "src"))]
        reached = reached.unionAll(near[0]).unionAll(near[1]).distinct()
    return reached


def quotient_neighbours(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(concept, neighbour): concepts with an edge between their members, both ways, each pair once."""
    own = members.select(F.col("node_id").alias("src"), F.col("concept_id").alias("concept"))
    other = members.select(F.col("node_id").alias("dst"), F.col("concept_id").alias("neighbour"))
    pairs = edges.select("src", "dst").join(own, "src").join(other, "dst").where("concept <> neighbour")
    both = F.explode(F.array(F.struct("concept", "neighbour"), F.struct(F.col("neighbour").alias("concept"), F.col("concept").alias("neighbour"))))  # edges are read once
    return pairs.select(both.alias("pair")).select("pair.*").distinct()


# identities


def overlaps(new: DataFrame, old: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(community, concept_id, jaccard) of pairs that share members (community, node_id and concept_id, node_id), at or above the threshold."""
    new_size = new.groupBy("community").agg(F.count("*").alias("n_new"))
    old_size = old.groupBy("concept_id").agg(F.count("*").alias("n_old"))
    shared = new.join(old, "node_id").groupBy("community", "concept_id").agg(F.count("*").alias("c"))
    j = F.col("c") / (F.col("n_new") + F.col("n_old") - F.col("c"))
    return shared.join(new_size, "community").join(old_size, "concept_id").select("community", "concept_id", j.alias("jaccard")).where(F.col("jaccard") >= threshold)


def greedy_matches(scored: DataFrame) -> DataFrame:
    """One-to-one pairs of a greedy pass over (jaccard, community, concept_id) descending.

    A pair that is the best of both its sides is what the pass would take first, so rounds of
    mutual best pairs give the same result; each round is a checkpoint.
    """
    order = [F.desc("jaccard"), F.desc("community"), F.desc("concept_id")]
    ready_for_checkpoints(scored.sparkSession)
    left, taken = scored.checkpoint(), None
    while not left.isEmpty():
        ranked = left.select("*", F.row_number().over(Window.partitionBy("community").orderBy(*order)).alias("r1"), F.row_number().over(Window.partitionBy("concept_id").orderBy(*order)).alias("r2"))
        best = ranked.where("r1 = 1 AND r2 = 1").select("community", "concept_id", "jaccard").checkpoint()
        taken = best if taken is None else taken.unionAll(best)
        left = left.join(best.select("community"), "community", "left_anti").join(best.select("concept_id"), "concept_id", "left_anti").checkpoint()
    return taken if taken is not None else scored


def identify(new: DataFrame, old: DataFrame, *, threshold: float = 0.5, next_number: int = 0) -> DataFrame:
    """(community, concept_id, split_from, merged_from): ids that stay where a community matches one concept and no other pair is near.

    Others get new ids in the order of communities.
    """
    scored = overlaps(new, old, threshold)
    matched = greedy_matches(scored).select("community", F.col("concept_id").alias("own"))
    per_old = scored.groupBy(F.col("concept_id").alias("own")).agg(F.count("*").alias("k_old"))
    per_new = scored.groupBy("community").agg(F.count("*").alias("k_new"), F.array_join(F.array_sort(F.collect_set("concept_id")), ",").alias("near"))
    rows = new.select("community").distinct().join(matched, "community", "left").join(per_old, "own", "left").join(per_new, "community", "left")
    merge = F.coalesce(F.col("k_new") > 1, F.lit(False))
    split = F.coalesce(F.col("k_old") > 1, F.lit(False))
    rows = rows.select("community", "own", "near", merge.alias("merge"), split.alias("split"), (F.col("own").isNotNull() & ~merge & ~split).alias("kept"))
    tables = Tables(new.sparkSession, "identities")
    rows = tables.keep(rows)
    number = numbered(rows.where("NOT kept").select(F.col("community").alias("k")), ["k"], tables)
    rows = rows.join(number, rows["community"] == number["k"], "left")
    fresh = F.format_string("concept-%04d", (F.col("number") + next_number).cast("int"))
    return rows.select("community", F.when(F.col("kept"), F.col("own")).otherwise(fresh).alias("concept_id"), F.when(F.col("split"), F.col("own")).alias("split_from"), F.when(F.col("merge"), F.col("near")).alias("merged_from"))


def next_number(concepts: DataFrame) -> DataFrame:
    """One row: the number after the greatest of ids like concept-0042; others are passed over; 0 for none."""
    return concepts.select(F.coalesce(F.max(F.expr("try_cast(regexp_extract(concept_id, '-([0-9]+)$', 1) AS bigint)")) + 1, F.lit(0)).cast("long").alias("next"))
