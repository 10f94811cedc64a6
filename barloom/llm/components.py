"""Connected components of an edge table, by repeated contraction along scrambled priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import cut_lineage, forget


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), long, in any order and with repeats. Returns (id, component) for every id that
    has an edge to another one; component is the smallest id that its edges reach.

    Nodes are ranked by (hash, id). Each round points every node to its lowest-ranked neighbour (or
    itself), follows that pointer once more, maps both ends of each edge and drops what became a
    loop. Ranks are random along any path, so chains shrink by a constant factor a round and a star
    is gone after two. Only minima by key are aggregated: a hub's edges never meet in one task."""
    edges = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        rank = F.struct(F.xxhash64("to").alias("h"), F.col("to"))
        low = both.groupBy("id").agg(F.min(rank).alias("low"))
        mine = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("to"))
        up = cut_lineage(low.select("id", F.least("low", mine)["to"].alias("up")))
        # Merge joins: Spark splits a hub's side of one, and of no other.
        twice = up.hint("merge").join(up.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up"))
        if labels is None:
            moved = twice.select("id", F.col("up").alias("root"))
        else:
            moved = labels.hint("merge").join(twice.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("up", "root").alias("root"))
        old, labels = labels, cut_lineage(moved)
        ends_a = twice.select(F.col("id").alias("a"), F.col("up").alias("up_a"))
        ends_b = twice.select(F.col("id").alias("b"), F.col("up").alias("up_b"))
        merged = edges.hint("merge").join(ends_a, "a").hint("merge").join(ends_b, "b").where("up_a <> up_b")
        before, edges = edges, cut_lineage(merged.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
        forget(old, up, before)
        if edges.isEmpty():
            smallest = cut_lineage(labels.groupBy("root").agg(F.min("id").alias("component")))
            out = cut_lineage(labels.hint("merge").join(smallest, "root").select("id", "component"))
            forget(edges, labels, smallest)
            return out
