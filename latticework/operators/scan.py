"""Reductions by monoids, and prefix scans in two passes.

A window over a whole frame runs in one task. A scan here sums blocks of
consecutive positions first, scans the small table of block sums, and finishes
inside each block, so both passes are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
#: Blocks whose sums are scanned in one group.
GROUP = 1 << 10


@dataclass(frozen=True)
class Monoid:
    """An associative, commutative operation: its aggregate, its two-argument form and its identity."""

    aggregate: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    identity: object


PLUS = Monoid(F.sum, lambda a, b: a + b, 0)
TIMES = Monoid(F.product, lambda a, b: a * b, 1.0)
MAX = Monoid(F.max, lambda a, b: F.greatest(a, b), None)
MIN = Monoid(F.min, lambda a, b: F.least(a, b), None)
ANY = Monoid(F.bool_or, lambda a, b: a | b, False)
ALL = Monoid(F.bool_and, lambda a, b: a & b, True)


def reduce(df: DataFrame, value: Column, monoid: Monoid, name: str = "value", init=None) -> DataFrame:
    """One row; `init` is folded in once; an empty frame gives the identity."""
    out = F.coalesce(monoid.aggregate(value), F.lit(monoid.identity))
    return df.agg((out if init is None else F.coalesce(monoid.combine(F.lit(init), out), F.lit(init))).alias(name))


def prefix(sums: DataFrame, monoid: Monoid) -> DataFrame:
    """(__block, __before) of (__block, __own): the reduction of earlier blocks, by groups of GROUP blocks,
    so that one task sees a row per GROUP * BLOCK rows only."""
    grouped = sums.withColumn("__group", F.floor(F.col("__block") / GROUP).cast("long"))
    earlier = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("__group").agg(monoid.aggregate(F.col("__own")).alias("__all"))
    groups = groups.select("__group", monoid.aggregate(F.col("__all")).over(earlier).alias("__outside"))
    inside = monoid.aggregate(F.col("__own")).over(Window.partitionBy("__group").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    return grouped.withColumn("__within", inside).join(groups, "__group").select("__block", joined(F.col("__outside"), F.col("__within"), monoid).alias("__before"))


def joined(a: Column, b: Column, monoid: Monoid) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(monoid.combine(a, b))


def scan(df: DataFrame, value: str, monoid: Monoid, out: str, inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Add the prefix reduction by `idx`: of all rows before, and of the row itself if inclusive.
    A row without idx has no place: it stays, with a null, and counts nowhere."""
    blocked = df.withColumn("__block", F.floor(F.col("idx") / block).cast("long"))
    sums = blocked.where("__block is not null").groupBy("__block").agg(monoid.aggregate(F.col(value)).alias("__own"))
    frame = Window.partitionBy("__block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    both = blocked.where("__block is not null").withColumn("__inside", monoid.aggregate(F.col(value)).over(frame)).join(prefix(sums, monoid), "__block")
    placed = both.withColumn(out, F.coalesce(joined(F.col("__before"), F.col("__inside"), monoid), F.lit(monoid.identity))).drop("__block", "__before", "__inside")
    return placed.unionByName(blocked.where("__block is null").drop("__block").withColumn(out, F.lit(None).cast(placed.schema[out].dataType)))


def array_scan(values: Column, monoid: Monoid, inclusive: bool = True, reverse: bool = False) -> Column:
    """The prefix (or suffix) reductions inside an array, by the monoid's two-argument form; null elements count nowhere."""
    items = F.reverse(values) if reverse else values
    start = F.lit(monoid.identity).cast("double")
    take = lambda acc, x: F.coalesce(monoid.combine(acc["last"], x), acc["last"])
    step = lambda acc, x: F.struct(take(acc, x).alias("last"), F.concat(acc["out"], F.array(take(acc, x) if inclusive else acc["last"])).alias("out"))
    out = F.aggregate(items, F.struct(start.alias("last"), F.array().cast("array<double>").alias("out")), step)["out"]
    return F.reverse(out) if reverse else out


def array_reduce(values: Column, monoid: Monoid) -> Column:
    return F.aggregate(values, F.lit(monoid.identity).cast("double"), monoid.combine)
