"""Adaptive grids in space: values of cells, and of whole cubes of cells, in a hierarchy of levels.

A node of level 0 holds 2^bits[0] cells a side, one of level n as many children of level n - 1 as 2^bits[n] a side. Nodes are
known by their least cell (i, j, k), so those above any cell follow from its coordinates, negative ones included. A level is a
frame with a row for every word of 64 places in a node that has any in use: (i, j, k, word, children, active, vals), where a bit
of `children` stands for a node below, a bit of `active` for a value, and `vals` holds the values in the order of the bits. On
higher levels a value is one of a whole cube (a tile); a child hides the tile in its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

AXES = ["i", "j", "k"]
WORD = 64


@dataclass
class Grid:
    """`levels` from the leaves up, each with `bits` of branching an axis; `background` is the value where there is none."""

    bits: tuple[int, ...]
    levels: list[DataFrame]
    background: float

    def cell(self, level: int) -> int:
        """Binary logarithm of the side of what one place of a node stands for."""
        return sum(self.bits[:level])


def _shift(name: str, x: Column, by: Column) -> Column:
    return F.call_function(name, x, by.cast("int"))


def _bit(at: Column) -> Column:
    return _shift("shiftleft", F.lit(1).cast("long"), at)


def _on(mask: Column, at: Column) -> Column:
    return _shift("shiftright", mask, at).bitwiseAND(F.lit(1)) == 1


def _key(bits: tuple[int, ...], level: int) -> tuple[list[Column], Column]:
    """The node above the cell in the columns i, j, k, and the place in it."""
    side, cell = sum(bits[: level + 1]), sum(bits[:level])
    node, place = [], F.lit(0).cast("long")
    for a in AXES:
        inside = F.col(a).bitwiseAND(F.lit((1 << side) - 1))
        node.append((F.col(a) - inside).alias(a))
        place = F.shiftleft(place, bits[level]).bitwiseOR(F.shiftright(inside, cell))
    return node, place


def _placed(df: DataFrame, bits: tuple[int, ...], level: int, *keep: str) -> DataFrame:
    node, place = _key(bits, level)
    return df.select(*node, F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(WORD - 1)).alias("__at"), *keep)


def _valued(values: DataFrame, bits: tuple[int, ...], level: int, combine: Callable[[Column], Column]) -> DataFrame:
    """Words of one level from rows (i, j, k, v). Rows of one place are combined before they are gathered, so a word gathers 64 at most."""
    rows = values.select(*[F.col(a).cast("long").alias(a) for a in AXES], F.col("v").cast("double").alias("v")).dropna(subset=AXES)
    one = _placed(rows, bits, level, "v").groupBy(*AXES, "word", "__at").agg(combine(F.col("v")).alias("v"))
    packed = F.array_sort(F.collect_list(F.struct("__at", "v")))
    return one.groupBy(*AXES, "word").agg(F.bit_or(_bit(F.col("__at"))).alias("active"), F.transform(packed, lambda x: x["v"]).alias("vals"))


def build(values: dict[int, DataFrame], bits: tuple[int, ...], background: float = 0.0, combine: Callable[[Column], Column] = F.max) -> Grid:
    """A grid of values (i, j, k, v) by level: 0 for cells, higher ones for tiles, which any of their cells names.

    Values in one place are combined. Rows without a coordinate are left out; a null value is one like others."""
    if not bits or min(bits) < 1 or any(not 0 <= level < len(bits) for level in values):
        raise ValueError("a level needs at least one bit, and values a level that exists")
    return complete(bits, {level: _valued(df, bits, level, combine) for level, df in values.items()}, background)


def complete(bits: tuple[int, ...], words: dict[int, DataFrame], background: float) -> Grid:
    """The topology above words of values, bottom up: every node has a parent that knows it. Each level is written once;
    children's bits and own values meet in one shuffle."""
    levels: list[DataFrame] = []
    for level in range(len(bits)):
        parts = []
        if level in words:
            parts.append(words[level].select(*AXES, "word", F.lit(0).cast("long").alias("children"), "active", "vals"))
        if level:
            below = _placed(levels[-1].select(*AXES).distinct(), bits, level).select(*AXES, "word", _bit(F.col("__at")).alias("children"), F.lit(0).cast("long").alias("active"), F.lit(None).cast("array<double>").alias("vals"))
            parts.append(below)
        if not parts:
            parts.append(next(iter(words.values())).where("false").select(*AXES, "word", F.lit(0).cast("long").alias("children"), "active", "vals"))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        # A word of values is one row, so there is one array at most.
        own = F.coalesce(F.first("vals", ignorenulls=True), F.array().cast("array<double>"))
        levels.append(cut(rows.groupBy(*AXES, "word").agg(F.bit_or("children").alias("children"), F.bit_or("active").alias("active"), own.alias("vals"))))
    return Grid(tuple(bits), levels, float(background))


def nodes(grid: Grid) -> DataFrame:
    """(level, nodes, values): how many of each there are, hidden tiles included."""
    counted = None
    for level, words in enumerate(grid.levels):
        per_node = words.groupBy(*AXES).agg(F.sum(F.bit_count("active")).alias("n"))
        one = per_node.agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("values"))
        counted = one if counted is None else counted.unionByName(one)
    return counted


def probe(grid: Grid, points: DataFrame) -> DataFrame:
    """Points (i, j, k, ..) with `level`, `active` and `v`: the value of the cell, or else of the tile, that has them, or the background.

    A descent from the root: a level is met by a plain join on the node's word, which adaptive execution broadcasts where
    the level is small and splits where many points need one word. A point without a coordinate has the background, at the root."""
    out, found = points, None
    for level in range(len(grid.bits)):
        node, place = _key(grid.bits, level)
        at, word = f"__at{level}", f"__w{level}"
        keys = [f"__{a}{level}" for a in AXES]
        out = out.withColumns({**{k: c for k, c in zip(keys, node, strict=True)}, word: F.shiftright(place, 6), at: place.bitwiseAND(F.lit(WORD - 1))})
        words = grid.levels[level].select(*[F.col(a).alias(k) for a, k in zip(AXES, keys, strict=True)], F.col("word").alias(word), F.struct("children", "active", "vals").alias(f"__n{level}"))
        out = out.join(words, [*keys, word], "left").drop(*keys, word)
        n = F.col(f"__n{level}")
        active = F.coalesce(_on(n["active"], F.col(at)), F.lit(False))
        rank = F.bit_count(n["active"].bitwiseAND(F.bitwise_not(_shift("shiftleft", F.lit(-1).cast("long"), F.col(at)))))
        own = F.struct(F.lit(level).alias("level"), active.alias("active"), F.when(active, F.get(n["vals"], rank)).otherwise(F.lit(grid.background)).alias("v"))
        found = own if found is None else F.when(_on(n["children"], F.col(at)), found).otherwise(own)
    out = out.withColumn("__found", found)
    return out.select(*points.columns, "__found.level", "__found.active", "__found.v")


def values(grid: Grid) -> DataFrame:
    """(level, i, j, k, v): all values that no child hides, by the least cell of their cube."""
    every = None
    for level, words in enumerate(grid.levels):
        bits, cell = grid.bits[level], grid.cell(level)
        on = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: _on(F.col("active"), b))
        pairs = F.explode(F.arrays_zip(on.alias("at"), F.col("vals").alias("v")))
        rows = words.where("active <> 0").select(*AXES, "word", "children", pairs.alias("__p")).where(~_on(F.col("children"), F.col("__p.at")))
        place = F.col("word") * WORD + F.col("__p.at")
        inside = [F.shiftleft(F.shiftright(place, bits * (2 - n)).bitwiseAND(F.lit((1 << bits) - 1)), cell) for n in range(3)]
        one = rows.select(F.lit(level).alias("level"), *[(F.col(a) + c).alias(a) for a, c in zip(AXES, inside, strict=True)], F.col("__p.v").alias("v"))
        every = one if every is None else every.unionByName(one)
    return every


def restructure(grid: Grid, bits: tuple[int, ...]) -> Grid:
    """The same values under another branching.

    A value goes to the highest level whose cubes are no larger than its own, as all those that its cube is made of, fewer than a
    node there has places; so every cell has the value that it had."""
    cells = [sum(bits[:n]) for n in range(len(bits))]
    moved: dict[int, DataFrame] = {}
    every = cut(values(grid))
    for level in range(len(grid.bits)):
        size = grid.cell(level)
        to = max(n for n, c in enumerate(cells) if c <= size)
        rows = every.where(F.col("level") == level).select(*AXES, "v")
        step, last = 1 << cells[to], (1 << size) - 1
        for a in AXES if size > cells[to] else ():
            rows = rows.withColumn(a, F.explode(F.sequence(F.col(a), F.col(a) + last, F.lit(step).cast("long"))))
        moved[to] = rows if to not in moved else moved[to].unionByName(rows)
    return build(moved, bits, grid.background)


def sample(grid: Grid, points: DataFrame) -> DataFrame:
    """(id, v): the grid between its cells, linear along each axis, at points (id, x, y, z) in units of cells; ids must be unique.

    Places without a value count as the background. A point with a null or NaN coordinate has a null."""
    sides = points.select("id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    near = sides.where(F.forall(F.array("x", "y", "z"), lambda c: c.isNotNull() & ~F.isnan(c)))
    weight = F.lit(1.0)
    for c, a in zip("xyz", AXES, strict=True):
        share = F.col(c) - F.floor(c)
        near = near.withColumn(f"__{a}", F.explode(F.array(*[F.struct((F.floor(c) + n).cast("long").alias("at"), w.alias("w")) for n, w in ((0, 1.0 - share), (1, share))])))
        weight = weight * F.col(f"__{a}.w")
    corners = near.select("id", *[F.col(f"__{a}.at").alias(a) for a in AXES], weight.alias("__w")).where("__w > 0")
    sums = probe(grid, corners).groupBy("id").agg(F.sum(F.col("__w") * F.col("v")).alias("v"))
    return sides.select("id").join(sums, "id", "left")
