"""Seeded random channels and point samplers: a value follows from a row's position alone, so reruns,
recomputed partitions and other partitionings agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash32
from ..operators.spatial import finite


def bits(idx: Column, seed: int, stream: int = 0) -> Column:
    """32 random bits of a position; streams are independent."""
    return hash32(hash32(idx.cast("long") + F.lit(seed * 2654435769 % (1 << 32))) + F.lit(stream * 40503 + 1))


def uniform(idx: Column, seed: int, stream: int = 0, low: float = 0.0, high: float = 1.0) -> Column:
    return bits(idx, seed, stream) / F.lit(float(1 << 32)) * F.lit(high - low) + F.lit(low)


def integers(idx: Column, seed: int, stream: int, low: int, high: int) -> Column:
    """low .. high - 1."""
    return F.floor(uniform(idx, seed, stream) * F.lit(high - low)).cast("long") + F.lit(low)


def normal(idx: Column, seed: int, stream: int = 0) -> Column:
    """From two uniform numbers, the first one shifted off 0."""
    radius = F.sqrt(-2 * F.log((bits(idx, seed, stream) + 1) / F.lit(float((1 << 32) + 1))))
    return radius * F.cos(uniform(idx, seed, stream + 1) * F.lit(6.283185307179586))


def in_box(idx: Column, seed: int, low: list[float], high: list[float]) -> list[Column]:
    return [uniform(idx, seed, k, a, b) for k, (a, b) in enumerate(zip(low, high, strict=True))]


def in_ball(idx: Column, seed: int, centre: list[float], radius: float) -> list[Column]:
    """Evenly in a ball: cube root of a uniform number as distance, height and angle as direction."""
    r = F.cbrt(uniform(idx, seed, 0)) * F.lit(radius)
    z, angle = uniform(idx, seed, 1, -1.0, 1.0), uniform(idx, seed, 2, 0.0, 6.283185307179586)
    flat = F.sqrt(1 - z * z)
    return [centre[0] + r * flat * F.cos(angle), centre[1] + r * flat * F.sin(angle), centre[2] + r * z]


def barycentric(idx: Column, seed: int) -> list[Column]:
    """Evenly in a triangle: three weights that sum to one."""
    a, b = F.sqrt(uniform(idx, seed, 0)), uniform(idx, seed, 1)
    return [1 - a, a * (1 - b), a * b]


def rotation_quaternion(idx: Column, seed: int) -> list[Column]:
    """A unit quaternion, evenly among turns."""
    u, v, w = (uniform(idx, seed, k, 0.0, 1.0 if k == 0 else 6.283185307179586) for k in range(3))
    return [F.sqrt(1 - u) * F.sin(v), F.sqrt(1 - u) * F.cos(v), F.sqrt(u) * F.sin(w), F.sqrt(u) * F.cos(w)]


def poisson_disk(candidates: DataFrame, radius: float, seed: int = 0, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Points (id, axes ..) of which no two are closer than radius: a candidate stays if its random mark is less than
    those of all candidates around it.

    Cells are so small that all points of one are closer than radius: all but the least mark of a cell are beaten there. The
    least ones, one to a cell, are copied to the cells around and meet each place's least mark, so the work grows with the points."""
    size, reach = radius / len(axes) ** 0.5 * 0.999, int(len(axes) ** 0.5 * 1.002) + 1
    keys = [f"__c{k}" for k in range(len(axes))]
    points = finite(candidates, axes).where("id is not null").select("id", F.struct(bits(F.col("id"), seed).alias("bits"), F.col("id").alias("id")).alias("m"), *[F.col(a).cast("double").alias(f"__x{k}") for k, a in enumerate(axes)])
    points = points.select("*", *[F.floor(F.col(f"__x{k}") / size).cast("long").alias(c) for k, c in enumerate(keys)])
    places = [f"__x{k}" for k in range(len(axes))]
    least = points.groupBy(*keys).agg(F.min("m").alias("least"))
    dealt = points.join(least, keys)
    crowd = dealt.where("m > least").select("id")
    asked = dealt.where("m = least").select("m", *keys, *[F.col(x).alias(f"{x}a") for x in places]).distinct()
    for c in keys:
        asked = asked.withColumn(c, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)))
    d2 = sum(((F.col(f"{x}a") - F.col(x)) * (F.col(f"{x}a") - F.col(x)) for x in places[1:]), (F.col(f"{places[0]}a") - F.col(places[0])) * (F.col(f"{places[0]}a") - F.col(places[0])))
    marks = points.groupBy(*keys, *places).agg(F.min("m").alias("__m"))
    beaten = asked.join(marks, keys).where((F.col("__m") < F.col("m")) & (d2 < radius * radius)).select(F.col("m.id").alias("id"))
    return candidates.join(crowd.unionByName(beaten).distinct(), "id", "left_anti")


def sample_level_set(candidates: DataFrame, inside: Column, radius: float, seed: int = 0) -> DataFrame:
    """Poisson-disk points among the candidates where a signed distance is negative."""
    return poisson_disk(candidates.where(inside < 0), radius, seed)
