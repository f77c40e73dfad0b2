"""Connected components by contraction: each node takes the smallest id near it, edges are redrawn between what is left.

A round groups edges by node (the smallest neighbour is pre-aggregated, so a hub is no hot key), jumps pointers once
and rewrites the edges between the new labels; edges inside a label go. Rounds end when no edge is left. What a round
leaves is written to the shared folder, so no lineage grows and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node in edges (a, b). No edges: an empty table."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct(), "edges")
    labels = None
    while edges.head(1):
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"))
        near = stored(near, "near")
        up = near.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        step = stored(near.join(up, "label").select("node", F.col("higher").alias("label")), "step")
        if labels is None:
            labels = step.select("node", F.col("label").alias("component"))
        else:
            moved = step.select(F.col("node").alias("component"), "label")
            labels = stored(labels.join(moved, "component", "left").select("node", F.coalesce("label", "component").alias("component")), "labels")
        a, b = (step.select(F.col("node").alias(x), F.col("label").alias(f"new_{x}")) for x in "ab")
        redrawn = edges.join(a, "a").join(b, "b").where("new_a <> new_b")
        edges = stored(redrawn.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
