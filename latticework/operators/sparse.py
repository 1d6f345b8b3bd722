"""Sparse matrices as (row, col, val) frames, and products over semirings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    add: Callable[[Column], Column]
    multiply: Callable[[Column, Column], Column]
    identity: object


INF = float("inf")
PLUS_TIMES = Semiring(F.sum, lambda a, x: a * x, 0)
BOOLEAN = Semiring(F.bool_or, lambda a, x: a & x, False)
MIN_PLUS = Semiring(F.min, lambda a, x: a + x, INF)
MAX_PLUS = Semiring(F.max, lambda a, x: a + x, -INF)
MIN_TIMES = Semiring(F.min, lambda a, x: a * x, INF)
MAX_TIMES = Semiring(F.max, lambda a, x: a * x, -INF)


def build(triplets: DataFrame) -> DataFrame:
    """Sum the values of repeated places."""
    return triplets.groupBy("row", "col").agg(F.sum("val").alias("val"))


def topology(pairs: DataFrame, mirror: bool = False, unique: bool = False) -> DataFrame:
    """Places without values; `mirror` adds the transposed ones; `unique` says there are no repeats."""
    if mirror:
        pairs = pairs.select("row", "col").unionByName(pairs.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col")))
    return pairs.select("row", "col") if unique and not mirror else pairs.select("row", "col").distinct()


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), *[c for c in matrix.columns if c not in ("row", "col")])


def pointers(matrix: DataFrame, rows: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(row, degree, start) of every row, empty ones too; starts by a two-pass scan."""
    degrees = rows.join(matrix.groupBy("row").agg(F.count(F.lit(1)).alias("degree")), "row", "left").select("row", F.coalesce("degree", F.lit(0)).alias("degree"))
    blocked = degrees.withColumn("__b", F.floor(F.col("row") / block))
    sums = blocked.groupBy("__b").agg(F.sum("degree").alias("__own"))
    sums = sums.select("__b", F.coalesce(F.sum("__own").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("degree").over(Window.partitionBy("__b").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocked.join(sums, "__b").select("row", "degree", (F.col("__before") + inside).alias("start"))


def ordered_rows(matrix: DataFrame) -> DataFrame:
    """Each row's entries in column order."""
    return matrix.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("entries"))


def spmv(matrix: DataFrame, x: DataFrame, rows: DataFrame, ring: Semiring = PLUS_TIMES, mask: DataFrame | None = None) -> DataFrame:
    """y = matrix (x) over a semiring: (row, y) for all `rows`. Rows in `mask` keep the identity.
    Entries without an x contribute nothing."""
    if mask is not None:
        matrix = matrix.join(mask.select("row"), "row", "left_anti")
    terms = matrix.join(x.select(F.col("idx").alias("col"), "x"), "col")
    sums = terms.groupBy("row").agg(ring.add(ring.multiply(F.col("val"), F.col("x"))).alias("y"))
    return rows.join(sums, "row", "left").select("row", F.coalesce("y", F.lit(ring.identity)).alias("y"))


def accumulate(y: DataFrame, product: DataFrame) -> DataFrame:
    """y += product."""
    return y.join(product.select("row", F.col("y").alias("__p")), "row", "left").select("row", (F.col("y") + F.coalesce("__p", F.lit(0))).alias("y"))


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices."""
    other = b.select(F.col("row").alias("k"), F.col("col").alias("j"), F.col("val").alias("w"))
    return a.select("row", F.col("col").alias("k"), "val").join(other, "k").groupBy("row", F.col("j").alias("col")).agg(F.sum(F.col("val") * F.col("w")).alias("val"))


def coefficients(matrix: DataFrame, places: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(row, col, val) at the given places, 0 where the matrix has nothing; `columns` are those that exist."""
    if columns is not None:
        places = places.join(columns.select("col"), "col", "left_semi")
    return places.select("row", "col").join(matrix, ["row", "col"], "left").select("row", "col", F.coalesce("val", F.lit(0)).alias("val"))


def identity(rows: DataFrame, value: float = 1.0) -> DataFrame:
    return rows.select("row", F.col("row").alias("col"), F.lit(value).alias("val"))


def diagonal(vector: DataFrame) -> DataFrame:
    """A diagonal matrix of (idx, x)."""
    return vector.select(F.col("idx").alias("row"), F.col("idx").alias("col"), F.col("x").alias("val"))
