"""Spatial joins through grid cells: overlaps, radius, nearest, hashing and buckets.

Both sides are dealt into cells and meet by an equi-join; a residual predicate
decides, and a pair counts only in the one cell where both first meet, so no
distinct is needed. Cells that hold more than HOT rows are dealt over slots:
one side at random, the other copied to each slot; where boxes meet boxes, both sides are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tree
from .lineage import cut

HOT = 100_000
#: Rows of either side in a slot of a cell in which boxes crowd.
SLOT = 10_000


def cells(low: str, high: str, size: float) -> Column:
    return F.sequence(F.floor(F.col(low) / size).cast("long"), F.floor(F.col(high) / size).cast("long"))


def slotted(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join rows (.., id_a) and (.., id_b) of the same cell, those of cells with more than HOT rows of `left` over slots."""
    full = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(*keys, F.ceil(F.col("n") / HOT).cast("int").alias("slots"))
    left = left.join(full, keys, "left").withColumn("slot", F.coalesce(F.pmod(F.xxhash64("id_a"), F.col("slots")), F.lit(0)).cast("int")).drop("slots")
    right = right.join(full, keys, "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
    return left.join(right, [*keys, "slot"]).drop("slot")


def spread(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join rows (.., id_a) and (.., id_b) of the same cell. Cells in which more than SLOT * SLOT pairs meet are dealt over slots, SLOT
    rows of each side to a slot, so that no task meets a whole cell.

    Both sides are hashed into as many parts as there are shuffle partitions: what a part costs is its pairs, which Spark does not
    see when it merges small parts or broadcasts a side."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    slots = lambda n: F.ceil(F.col(n) / SLOT).cast("int")
    full = count(left, "n").join(count(right, "m"), keys).where(F.col("n") * F.col("m") > SLOT * SLOT)
    full = cut(full.select(*keys, slots("n").alias("n"), slots("m").alias("m")))
    if full.isEmpty():
        return left.repartition(parts, *keys).join(right.hint("merge").repartition(parts, *keys), keys)
    one = F.coalesce(F.col("n"), F.lit(1)), F.coalesce(F.col("m"), F.lit(1))
    deal = lambda df, own, other, k, j, i: df.join(full, keys, "left").withColumns({k: F.pmod(F.xxhash64(i), own).cast("int"), j: F.explode(F.sequence(F.lit(0), other - 1))}).drop("n", "m")
    left, right = deal(left, *one, "sa", "sb", "id_a"), deal(right, *one[::-1], "sb", "sa", "id_b")
    by = [*keys, "sa", "sb"]
    return left.repartition(parts, *by).join(right.hint("merge").repartition(parts, *by), by).drop("sa", "sb")


def box_join(a: DataFrame, b: DataFrame, size: tuple[float, float], self_join: bool = False) -> DataFrame:
    """Pairs (id_a, id_b) of overlapping closed boxes (id, minx, maxx, miny, maxy); of a frame
    with itself each pair once, the smaller id first."""
    def dealt(df: DataFrame, s: str) -> DataFrame:
        df = df.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "minx", "maxx", "miny", "maxy")])
        return df.withColumn("cx", F.explode(cells(f"minx_{s}", f"maxx_{s}", size[0]))).withColumn("cy", F.explode(cells(f"miny_{s}", f"maxy_{s}", size[1])))

    pairs = spread(dealt(a, "a"), dealt(b, "b"), ["cx", "cy"])
    meet = (F.col("minx_b") <= F.col("maxx_a")) & (F.col("maxx_b") >= F.col("minx_a")) & (F.col("miny_b") <= F.col("maxy_a")) & (F.col("maxy_b") >= F.col("miny_a"))
    first = (F.col("cx") == F.floor(F.greatest("minx_a", "minx_b") / size[0])) & (F.col("cy") == F.floor(F.greatest("miny_a", "miny_b") / size[1]))
    pairs = pairs.where(meet & first)
    return (pairs.where("id_a < id_b") if self_join else pairs).select("id_a", "id_b")


def finite(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Points whose coordinates are all numbers; others are near nothing."""
    return points.where(F.forall(F.array(*[F.col(a).cast("double") for a in axes]), lambda x: F.abs(x) < F.lit(float("inf"))))


def neighbours(a: DataFrame, b: DataFrame, size: float, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Visit, for each point (id, axes ..) of `a`, the points of `b` in its own cell and those around it: (id_a, xa, ya, .., id_b,
    xb, yb, ..). Each pair comes once, so any condition or sum over neighbours can follow; a point with a coordinate that is
    no number visits nothing."""
    keys = [f"c{x}" for x in axes]
    left = finite(a, axes).select(F.col("id").alias("id_a"), *[F.col(x).alias(f"{x}a") for x in axes], *[F.floor(F.col(x) / size).alias(k) for x, k in zip(axes, keys, strict=True)])
    right = finite(b, axes).select(F.col("id").alias("id_b"), *[F.col(x).alias(f"{x}b") for x in axes])
    for x, k in zip(axes, keys, strict=True):
        cell = F.floor(F.col(f"{x}b") / size)
        right = right.withColumn(k, F.explode(F.array(cell - 1, cell, cell + 1)))
    return slotted(left, right, keys).drop(*keys)


def radius_join(a: DataFrame, b: DataFrame, radius: float, strict: bool = True, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """(id_a, id_b, d2) of points (id, axes ..) closer than radius; a point is no neighbour of its own id."""
    d2 = None
    for x in axes:
        gap = F.col(f"{x}a") - F.col(f"{x}b")
        d2 = gap * gap if d2 is None else d2 + gap * gap
    pairs = neighbours(a, b, radius, axes).withColumn("d2", d2).where("id_a <> id_b")
    return pairs.where(F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius).select("id_a", "id_b", "d2")


def nearest(probes: DataFrame, targets: DataFrame, start: float, rounds: int = 60, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """(id_a, id_b, d2): each probe's nearest target, the smallest id among equals.

    Along up to three axes targets are the leaves of a tree of boxes, one for each place, so a probe meets those that may be
    nearest, however far away it is. Along more axes the radius grows fourfold from `start`
    until every probe has found a target within it. The other columns are null where there is no target, of probes with a
    coordinate that is no number, and of those that have found none after all rounds.
    """
    none = lambda df: df.select(F.col("id").alias("id_a"), F.lit(None).cast("long").alias("id_b"), F.lit(None).cast("double").alias("d2"))
    targets = finite(targets, axes)
    if targets.isEmpty():
        return none(probes)
    numbers = F.forall(F.array(*[F.col(a).cast("double") for a in axes]), lambda x: F.abs(x) < F.lit(float("inf")))
    every = cut(probes.withColumn("__finite", F.coalesce(numbers, F.lit(False))))
    left, done, radius = every.where("__finite"), none(every.where("not __finite")), start
    if len(axes) <= 3:
        by = dict(zip("xyz", [F.col(a).cast("double") for a in axes] + [F.lit(0.0)] * (3 - len(axes)), strict=True))
        places = targets.groupBy(*[c.alias(f"min{k}") for k, c in by.items()]).agg(F.min("id").alias("id"))
        built = tree.build(places.select("id", *[c for k in by for c in (f"min{k}", F.col(f"min{k}").alias(f"max{k}"))]))
        found = tree.nearest(built, left.select("id", *[c.alias(k) for k, c in by.items()]))
        return done.unionByName(found.select("id_a", F.col("id_b").cast("long").alias("id_b"), "d2"))
    targets = targets.withColumn("id", -F.col("id") - 1)
    for _ in range(rounds):
        near = radius_join(left, targets, radius, strict=False, axes=axes)
        best = cut(near.groupBy("id_a").agg(F.min(F.struct("d2", (-F.col("id_b") - 1).alias("id_b"))).alias("m")).select("id_a", F.col("m.id_b").alias("id_b"), F.col("m.d2").alias("d2")))
        done = done.unionByName(best)
        left, radius = cut(left.join(best, left.id == best.id_a, "left_anti")), radius * 4
        if left.isEmpty():
            return done
    return done.unionByName(none(left))


def hash_cells(boxes: DataFrame, size: float) -> DataFrame:
    """(cx, cy, id): cells from floor(min / size) up to, but without, ceil(max / size)."""
    span = lambda lo, hi: F.filter(F.sequence(F.floor(F.col(lo) / size).cast("long"), F.ceil(F.col(hi) / size).cast("long")), lambda c: c < F.ceil(F.col(hi) / size))
    return boxes.select("id", F.explode(span("minx", "maxx")).alias("cx"), "miny", "maxy").select("id", "cx", F.explode(span("miny", "maxy")).alias("cy"))


def buckets(points: DataFrame, size: float, collocated: bool = True) -> DataFrame:
    """(cx, cy, n, first): points by cell, cells centred on nodes if collocated."""
    at = lambda c: F.floor(F.col(c) / size + (0.5 if collocated else 0.0)).cast("long")
    return points.groupBy(at("x").alias("cx"), at("y").alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def bucketed(points: DataFrame, size: float, axes: Sequence[str] = ("x", "y", "z")) -> tuple[DataFrame, DataFrame]:
    """Buckets (cells .., n, first) and their members (place, id): those of a bucket stand at first .. first + n - 1, by id.

    One global sort numbers the members, so no bucket is gathered, however large."""
    from .order import numbered

    keys = [f"c{a}" for a in axes]
    placed = finite(points, axes).select("id", *[F.floor(F.col(a) / size).cast("long").alias(k) for a, k in zip(axes, keys, strict=True)])
    members = numbered(placed, *[F.col(k) for k in keys], F.col("id"), out="place")
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")), members.select("place", "id")


def partition(points: DataFrame, size: float, block: int) -> DataFrame:
    """Distinct blocks of the points' base nodes."""
    node = lambda c: F.floor((F.floor(F.col(c) / size + 0.5) - 2) / block).cast("long")
    return points.select(node("x").alias("bx"), node("y").alias("by")).distinct()


def enlarge(blocks: DataFrame, low: int, high: int) -> DataFrame:
    """Blocks with all neighbours at offsets low .. high - 1."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(low, high) for j in range(low, high)])
    return blocks.withColumn("o", F.explode(steps)).select((F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by")).distinct()


def bounding_box(df: DataFrame, columns: list[str], pad: float = 0.0) -> DataFrame:
    return df.agg(*[(F.min(c) - pad).alias(f"min_{c}") for c in columns], *[(F.max(c) + pad).alias(f"max_{c}") for c in columns])
