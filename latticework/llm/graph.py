"""Connected components of an edge table, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Steps along the hooks that a node takes in one round.
HOPS = 3


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge, root being the least node it reaches.

    `edges` has long columns a and b, never null. In each round a node hooks to the neighbour of
    least hash, if that is less than its own, and follows such hooks HOPS times; then the edges move
    to where their ends have come, and edges within one node go. Hashes are random whatever the ids
    are, so a round leaves a fraction of the nodes. What a round makes is written once. Sums over a
    node with very many edges are combined before they are shuffled, and written, so that all joins
    stand on plain exchanges, which adaptive execution splits where one node has very many.
    """
    left, placed = edges.where("a <> b").select("a", "b"), None
    while placed is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = F.least(F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v")), F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))))
        first = cut(both.groupBy("a").agg(hook.alias("up")).select("a", F.col("up.v").alias("up")), "first")
        step = first
        for _ in range(HOPS - 1):
            step = step.join(first.select(F.col("a").alias("up"), F.col("up").alias("top")), "up").select("a", F.col("top").alias("up"))
        step = cut(step, "hooks")
        ends = step.select(F.col("a").alias("b"), F.col("up").alias("ub"))
        left = cut(left.join(step, "a").join(ends, "b").where("up <> ub").select(F.col("up").alias("a"), F.col("ub").alias("b")).distinct(), "edges")
        moved = step.select(F.col("a").alias("up"), F.col("up").alias("top"))
        placed = step if placed is None else placed.join(moved, "up", "left").select("a", F.coalesce("top", "up").alias("up"))
    placed = cut(placed, "placed")
    least = cut(placed.groupBy("up").agg(F.min("a").alias("root")), "least")
    return placed.join(least, "up").select(F.col("a").alias("node"), "root")
