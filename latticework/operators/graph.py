"""Iterative graph algorithms on edge frames (src, dst), driven to a fixed point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def components(edges: DataFrame, skip: Column | None = None) -> DataFrame:
    """(v, label): the least vertex that each vertex reaches over edges for which `skip` is not true.

    In each round a vertex hooks to its neighbour of least hash and follows two more such hooks; the edges then move
    to where their ends have come, and those within one vertex go, so a round leaves a fraction of the graph. Sums over
    a vertex of very many edges are combined before they are shuffled, and written: all joins stand on plain exchanges, which
    adaptive execution splits where one vertex has very many."""
    if skip is not None:
        edges = edges.where(~F.coalesce(skip, F.lit(False)))
    left, placed = edges.select("src", "dst"), None
    hashed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    while placed is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        first = cut(both.groupBy("src").agg(F.least(hashed("src"), F.min(hashed("dst"))).alias("up")).select(F.col("src").alias("v"), F.col("up.v").alias("up")))
        hop = first.select(F.col("v").alias("up"), F.col("up").alias("top"))
        step = cut(first.join(hop, "up").select("v", F.col("top").alias("up")).join(hop, "up").select("v", F.col("top").alias("up")))
        one, two = step.select(F.col("v").alias("src"), F.col("up").alias("a")), step.select(F.col("v").alias("dst"), F.col("up").alias("b"))
        left = cut(left.join(one, "src").join(two, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        moved = step.select(F.col("v").alias("up"), F.col("up").alias("top"))
        placed = step if placed is None else placed.join(moved, "up", "left").select("v", F.coalesce("top", "up").alias("up"))
    placed = cut(placed)
    least = cut(placed.groupBy("up").agg(F.min("v").alias("label")))
    return placed.join(least, "up").select("v", "label")


def color(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(v, color): in each round the local maxima among uncoloured vertices take the next
    colour and the local minima the one after. `weights` has (v, weight), all different."""
    both, left, done, number = cut(mirrored(edges)), cut(weights), None, 0
    while not left.isEmpty():
        a, b = left.select(F.col("v").alias("src"), F.col("weight").alias("wa")), left.select(F.col("v").alias("dst"), F.col("weight").alias("wb"))
        near = both.join(a, "src").join(b, "dst").groupBy("src").agg(F.max("wb").alias("high"), F.min("wb").alias("low"))
        seen = left.join(near, left.v == near.src, "left")
        top = F.col("high").isNull() | (F.col("weight") > F.col("high"))
        bottom = F.col("low").isNotNull() & (F.col("weight") < F.col("low"))
        new = cut(seen.select("v", "weight", F.when(top, number + 1).when(bottom, number + 2).alias("color")))
        chosen = new.where("color is not null").select("v", "color")
        done = chosen if done is None else done.unionByName(chosen)
        left, number = new.where("color is null").select("v", "weight"), number + 2
    return done if done is not None else weights.select("v", F.lit(0).alias("color"))


def maximal_independent_color(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(v, color): each colour is a maximal independent set, grown from local minima."""
    both, left, done, number = cut(mirrored(edges)), cut(weights), None, 0
    while not left.isEmpty():
        number += 1
        free = left
        while not free.isEmpty():
            a, b = free.select(F.col("v").alias("src"), F.col("weight").alias("wa")), free.select(F.col("v").alias("dst"), F.col("weight").alias("wb"))
            lower = both.join(a, "src").join(b, "dst").where("wb < wa").select(F.col("src").alias("v")).distinct()
            chosen = cut(free.join(lower, "v", "left_anti").select("v", F.lit(number).alias("color")))
            done = chosen if done is None else done.unionByName(chosen)
            blocked = both.join(chosen.select(F.col("v").alias("src")), "src").select(F.col("dst").alias("v")).distinct()
            left = cut(left.join(chosen, "v", "left_anti"))
            free = cut(free.join(chosen, "v", "left_anti").join(blocked, "v", "left_anti"))
    return done if done is not None else weights.select("v", F.lit(0).alias("color"))


def augmenting_path(residual: DataFrame, source: int, sink: int) -> list[tuple[int, int, float]]:
    """Edges of a shortest path with capacity left, by levels; empty if there is none.
    The driver sees the path alone."""
    seen = cut(residual.sparkSession.createDataFrame([(source, None, None, 0)], "v long, parent long, cap double, level int"))
    level = 0
    while True:
        front = seen.where(F.col("level") == level).select(F.col("v").alias("src"))
        near = residual.where("cap > 0").join(front, "src").groupBy(F.col("dst").alias("v")).agg(F.min(F.struct("src", "cap")).alias("m"))
        new = cut(near.join(seen.select("v"), "v", "left_anti").select("v", F.col("m.src").alias("parent"), F.col("m.cap").alias("cap"), F.lit(level + 1).alias("level")))
        if new.isEmpty():
            return []
        seen, level = cut(seen.unionByName(new)), level + 1
        if not new.where(F.col("v") == sink).isEmpty():
            break
    path, v = [], sink
    while v != source:
        row = seen.where(F.col("v") == v).first()
        path.append((row.parent, v, row.cap))
        v = row.parent
    return path[::-1]


def maximum_flow(edges: DataFrame, source: int, sink: int) -> float:
    """Edmonds-Karp over (src, dst, cap); missing reverse edges start with no capacity."""
    zero = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("cap"))
    residual = cut(edges.select("src", "dst", F.col("cap").cast("double").alias("cap")).unionByName(zero).groupBy("src", "dst").agg(F.sum("cap").alias("cap")))
    total = 0.0
    while path := augmenting_path(residual, source, sink):
        amount = min(c for *_, c in path)
        change = [(a, b, -amount) for a, b, _ in path] + [(b, a, amount) for a, b, _ in path]
        moved = residual.sparkSession.createDataFrame(change, "src long, dst long, cap double")
        residual, total = cut(residual.unionByName(moved).groupBy("src", "dst").agg(F.sum("cap").alias("cap"))), total + amount
    return total
