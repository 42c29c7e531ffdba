"""Connected components of an undirected edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(v, root) for every vertex of edges (a, b: long); root is the least vertex of its component.

    Each round takes the least label among the neighbours (summed map-side, so that hubs
    are no hot groups) and then the label of that label; every round is a written table.
    """
    both = scratch.keep(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{label}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")), f"{label}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("m"))
        step = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("v").alias("root"), F.col("root").alias("up"))
        step = step.join(jump, "root", "left").select("v", "old", F.least("root", F.coalesce("up", "root")).alias("root"))
        step = scratch.keep(step, f"{label}-{k}")
        done = step.where("old <> root").isEmpty()
        scratch.drop(f"{label}-{k - 1}")
        labels = step.select("v", "root")
        if done:
            return labels
