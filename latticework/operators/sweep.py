"""Sweep and prune: overlaps of boxes in space along one axis.

Boxes are sorted once by their minimum on the axis on which they spread most. A box
is met by those that come after it and begin before it ends: a run of places,
found by an as-of search. A run is cut at blocks of places, and meets a block's boxes by an equi-join; so a
box is copied once per block of boxes that it must be compared with, never per cell of
space, and both sides are plain, which adaptive execution splits where one block is crowded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .order import numbered, search
from .tree import SIDES, whole

#: Places of a block.
BLOCK = 512
#: Cells that a box may be copied to where a frame meets itself, and bound of numbers whose cells are counted.
CELLS, FAR = 27, 1e15
#: Large boxes that are sent to all others, and copies per cell of a frame that is broadcast, at most.
FEW_LARGE, FEW_COPIES = 1000, 400_000


def longest_axis(boxes: DataFrame) -> str:
    """The axis on which boxes spread most, the lower one of equals."""
    ends = boxes.agg(*[(F.max(f"max{a}") - F.min(f"min{a}")).alias(a) for a in "xyz"]).first()
    return max("xyz", key=lambda a: (ends[a] or 0.0, -ord(a)))


def swept(boxes: DataFrame, axis: str, keep: Column) -> DataFrame:
    """Pairs (x, y) of overlapping boxes, borders included, x before y on the axis, for which `keep` holds; `x` and `y` are structs of boxes' columns."""
    placed = cut(numbered(boxes, F.col(f"min{axis}"), F.col("id"), F.col("side"), *[F.col(c) for c in SIDES], out="place").drop("__part"))
    ends = placed.select(F.col("place").alias("idx"), F.col(f"max{axis}").alias("probe"))
    last = search(placed.select("place", F.col(f"min{axis}").alias("v")), ends, "v", "probe").select(F.col("idx").alias("place"), F.col("place").alias("last"))
    runs = placed.join(last, "place").where("last > place")
    box = F.struct("place", "id", "side", *SIDES)
    runs = runs.select(box.alias("x"), "last", F.explode(F.sequence(F.floor((F.col("place") + 1) / BLOCK), F.floor(F.col("last") / BLOCK))).alias("block"))
    dealt = placed.select(box.alias("y"), F.floor(F.col("place") / BLOCK).alias("block"))
    meet = (F.col("y.place") > F.col("x.place")) & (F.col("y.place") <= F.col("last"))
    for a in "xyz":
        if a != axis:
            meet = meet & (F.col(f"x.min{a}") <= F.col(f"y.max{a}")) & (F.col(f"x.max{a}") >= F.col(f"y.min{a}"))
    return runs.join(dealt, "block").where(meet & keep).select("x", "y")


def sweep_join(a: DataFrame, b: DataFrame, axis: str | None = None) -> DataFrame:
    """(id_a, id_b) of overlapping boxes of two frames. Boxes with a null or NaN side, or that end before they begin, meet nothing; repeated ones meet as often as they come.

    Without an axis, boxes that cover at most CELLS cells, of twice the larger frame's median sides, meet in these, and a pair counts
    in the cell where both first meet: no box is compared with others of its own frame. Larger boxes are sent to all others if
    they are few, and swept against them if not."""
    a, b = whole(a).where(proper()), whole(b).where(proper())
    if axis is not None:
        return _swept_join(a, b, axis)
    found = [_medians(df) for df in (a, b)]
    size = {x: max(2 * found[0][1][x], 2 * found[1][1][x], 1e-100) for x in "xyz"}
    (few_a, large_a), (few_b, large_b) = (_parted(df, size) for df in (a, b))
    dealt = [_dealt(df, size, s) for df, s in ((few_a, "a"), (few_b, "b"))]
    lesser = 0 if found[0][0] <= found[1][0] else 1
    small = found[lesser][0] <= FEW_COPIES and dealt[lesser].count() <= FEW_COPIES
    dealt[lesser] = F.broadcast(dealt[lesser]) if small else dealt[lesser].hint("merge")
    pairs = dealt[0].join(dealt[1], ["cx", "cy", "cz"]).where(_meet(size)).select("id_a", "id_b")
    for x, y, large in ((large_a, b, large_a), (few_a, large_b, large_b)):
        n = large.count()
        if n:
            pairs = pairs.unionByName(_nested(x, y, large is large_a) if n <= FEW_LARGE else _swept_join(x, y, longest_axis(x.unionByName(y))))
    return pairs


def _swept_join(a: DataFrame, b: DataFrame, axis: str) -> DataFrame:
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    pairs = swept(both, axis, F.col("x.side") != F.col("y.side"))
    first = F.col("x.side") == 0
    return pairs.select(F.when(first, F.col("x.id")).otherwise(F.col("y.id")).alias("id_a"), F.when(first, F.col("y.id")).otherwise(F.col("x.id")).alias("id_b"))


def _nested(a: DataFrame, b: DataFrame, send_a: bool = True) -> DataFrame:
    """Pairs of few boxes, which are sent to all tasks, with the others."""
    one, two = (df.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", *SIDES)]) for df, s in ((a, "a"), (b, "b")))
    one, two = (F.broadcast(one), two) if send_a else (one, F.broadcast(two))
    return one.join(two, _meet()).select("id_a", "id_b")


def _meet(size: dict[str, float] | None = None) -> Column:
    """Boxes .._a and .._b overlap and, with the sides of cells, first do so in this cell."""
    meet = F.lit(True)
    for x in "xyz":
        meet = meet & (F.col(f"min{x}_a") <= F.col(f"max{x}_b")) & (F.col(f"max{x}_a") >= F.col(f"min{x}_b"))
        if size:
            meet = meet & (F.col(f"c{x}") == F.floor(F.greatest(f"min{x}_a", f"min{x}_b") / size[x]))
    return meet


def _medians(boxes: DataFrame) -> tuple[int, dict[str, float]]:
    """The number of boxes within FAR of 0 and about the median of their sides, at least 2^-20 of the spread of the middle half."""
    near = boxes.where(F.forall(F.array(*[F.col(c) for c in SIDES]), lambda v: F.abs(v) < FAR))
    middle = lambda x: F.percentile_approx(f"min{x}", F.array(F.lit(0.25), F.lit(0.75)), 1000)
    found = near.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col(f"max{x}") - F.col(f"min{x}"), 0.5, 1000).alias(x) for x in "xyz"], *[middle(x).alias(f"all{x}") for x in "xyz"]).first()
    return found["n"], {x: max(found[x], (found[f"all{x}"][1] - found[f"all{x}"][0]) * 2.0**-20) if found["n"] else 0.0 for x in "xyz"}


def _parted(boxes: DataFrame, size: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Boxes that cover at most CELLS cells, and the others."""
    spans = [F.floor(F.col(f"max{x}") / size[x]).cast("double") - F.floor(F.col(f"min{x}") / size[x]).cast("double") + 1 for x in "xyz"]
    small = F.forall(F.array(*[F.col(c) for c in SIDES]), lambda v: F.abs(v) < FAR) & F.forall(F.array(*[F.abs(F.col(f"{w}{x}")) / size[x] for x in "xyz" for w in ("min", "max")]), lambda v: v < FAR) & (spans[0] * spans[1] * spans[2] <= CELLS)
    return boxes.where(small), boxes.where(~small)


def _dealt(boxes: DataFrame, size: dict[str, float], side: str) -> DataFrame:
    """A row per box and cell that it covers, named for its side."""
    out = boxes
    for x in "xyz":
        out = out.withColumn(f"c{x}", F.explode(F.sequence(F.floor(F.col(f"min{x}") / size[x]).cast("long"), F.floor(F.col(f"max{x}") / size[x]).cast("long"))))
    return out.select("cx", "cy", "cz", *[F.col(c).alias(f"{c}_{side}") for c in ("id", *SIDES)])


def sweep_self(boxes: DataFrame, axis: str | None = None) -> DataFrame:
    """(id_a, id_b) of overlapping boxes of one frame, each pair once, the smaller id first; no box meets one of its own id.

    Without an axis, boxes that cover at most CELLS cells, of twice the mean sides, meet in these: a copy per cell, not one per block of
    boxes that overlap on one axis. A pair counts in the cell where both first meet. Larger boxes are swept against all."""
    own = whole(boxes).withColumn("side", F.lit(0)).where(proper())
    if axis is not None:
        return _ordered(swept(own, axis, F.col("x.id") != F.col("y.id")))
    own = cut(own)
    size = cell_sides(own)
    if size is None:
        return _ordered(swept(own, longest_axis(own), F.col("x.id") != F.col("y.id")))
    at = {a: (F.floor(F.col(f"min{a}") / size[a]), F.floor(F.col(f"max{a}") / size[a])) for a in "xyz"}
    spans = [hi.cast("double") - lo.cast("double") + 1 for lo, hi in at.values()]
    small = F.forall(F.array(*[F.col(c) for c in SIDES]), lambda v: F.abs(v) < FAR) & F.forall(F.array(*[F.abs(F.col(f"{w}{a}")) / size[a] for a in "xyz" for w in ("min", "max")]), lambda v: v < FAR) & (spans[0] * spans[1] * spans[2] <= CELLS)
    few = own.where(small)
    dealt = few.drop("side")
    for a, (lo, hi) in at.items():
        dealt = dealt.withColumn(f"c{a}", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    one, two = (dealt.select("cx", "cy", "cz", *[F.col(c).alias(f"{c}_{s}") for c in ("id", *SIDES)]) for s in "ab")
    meet = F.col("id_a") < F.col("id_b")
    for a in "xyz":
        meet = meet & (F.col(f"min{a}_a") <= F.col(f"max{a}_b")) & (F.col(f"max{a}_a") >= F.col(f"min{a}_b")) & (F.col(f"c{a}") == F.floor(F.greatest(f"min{a}_a", f"min{a}_b") / size[a]))
    pairs = one.hint("merge").join(two, ["cx", "cy", "cz"]).where(meet).select("id_a", "id_b")
    large = own.where(~small)
    if large.isEmpty():
        return pairs
    mixed = sweep_join(large, few, longest_axis(own)).where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return pairs.unionByName(mixed).unionByName(_ordered(swept(large, longest_axis(large), F.col("x.id") != F.col("y.id"))))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.id", "y.id").alias("id_a"), F.greatest("x.id", "y.id").alias("id_b"))


def cell_sides(boxes: DataFrame) -> dict[str, float] | None:
    """Twice the mean sides of the boxes within FAR of 0, at least 2^-20 of their spread; None if there are none."""
    near = boxes.where(F.forall(F.array(*[F.col(c) for c in SIDES]), lambda v: F.abs(v) < FAR))
    found = near.agg(*[F.avg(F.col(f"max{a}") - F.col(f"min{a}")).alias(a) for a in "xyz"], *[(F.max(f"max{a}") - F.min(f"min{a}")).alias(f"all{a}") for a in "xyz"]).first()
    return None if found["x"] is None else {a: max(2 * found[a], found[f"all{a}"] * 2.0**-20, 1e-100) for a in "xyz"}


def proper() -> Column:
    return (F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy")) & (F.col("minz") <= F.col("maxz"))
