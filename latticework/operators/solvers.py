"""Iterative linear solvers on sparse frames; vectors are (idx, x) frames, the driver sees scalars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


@dataclass
class Operator:
    """matrix (row, col, val); an optional diagonal preconditioner (idx, x) and fixed positions (idx)."""

    matrix: DataFrame
    inverse_diagonal: DataFrame | None = None
    fixed: DataFrame | None = None

    def multiply(self, x: DataFrame) -> DataFrame:
        terms = self.matrix.join(x.withColumnRenamed("idx", "col"), "col")
        sums = terms.groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("val") * F.col("x")).alias("x"))
        return x.select("idx").join(sums, "idx", "left").select("idx", F.coalesce("x", F.lit(0.0)).alias("x"))

    def project(self, x: DataFrame) -> DataFrame:
        if self.fixed is None:
            return x
        gone = self.fixed.select("idx", F.lit(True).alias("__f"))
        return x.join(gone, "idx", "left").select("idx", F.when(F.col("__f"), 0.0).otherwise(F.col("x")).alias("x"))

    def precondition(self, x: DataFrame) -> DataFrame:
        if self.inverse_diagonal is None:
            return x
        return x.join(self.inverse_diagonal.withColumnRenamed("x", "__d"), "idx").select("idx", (F.col("x") * F.col("__d")).alias("x"))


def dot(a: DataFrame, b: DataFrame) -> float:
    return a.join(b.withColumnRenamed("x", "y"), "idx").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0))).first()[0]


def combine(a: float, x: DataFrame, b: float, y: DataFrame) -> DataFrame:
    return x.join(y.withColumnRenamed("x", "y"), "idx").select("idx", (F.lit(a) * F.col("x") + F.lit(b) * F.col("y")).alias("x"))


def conjugate_gradient(a: Operator, b: DataFrame, tolerance: float = 1e-12, relative: float = 1e-9, limit: int = 1000) -> DataFrame:
    x = cut(b.select("idx", F.lit(0.0).alias("x")))
    r = cut(a.project(b))
    q = cut(a.precondition(r))
    p, zr = q, dot(q, r)
    stop = min(relative * zr**0.5, tolerance) if zr > 0 else 0.0
    for _ in range(limit):
        if zr**0.5 <= stop:
            break
        ap = cut(a.project(a.multiply(p)))
        step = zr / dot(p, ap)
        x, r = cut(combine(1.0, x, step, p)), cut(combine(1.0, r, -step, ap))
        q = cut(a.precondition(r))
        old, zr = zr, dot(q, r)
        if zr <= 0 or zr < 1e-30 * old:
            break
        p = cut(combine(1.0, q, zr / old, p))
    return x


def conjugate_residual(a: Operator, b: DataFrame, tolerance: float = 1e-18, limit: int = 1000) -> DataFrame:
    x, r = cut(b.select("idx", F.lit(0.0).alias("x"))), cut(a.project(b))
    p, ar = r, cut(a.project(a.multiply(r)))
    ap, rar = ar, dot(r, ar)
    stop = tolerance * max(dot(b, b), 1e-300)
    for _ in range(limit):
        if dot(r, r) <= stop:
            break
        step = rar / dot(ap, ap)
        x, r = cut(combine(1.0, x, step, p)), cut(combine(1.0, r, -step, ap))
        ar = cut(a.project(a.multiply(r)))
        old, rar = rar, dot(r, ar)
        if old == 0:
            break
        p, ap = cut(combine(1.0, r, rar / old, p)), cut(combine(1.0, ar, rar / old, ap))
    return x


def minres(a: Operator, b: DataFrame, tolerance: float = 1e-9, limit: int = 1000) -> DataFrame:
    """MINRES for symmetric matrices: Lanczos vectors, rotated as they come."""
    r = cut(a.project(b))
    beta = dot(r, r) ** 0.5
    zero = cut(b.select("idx", F.lit(0.0).alias("x")))
    x, v_old, v, w_old, w = zero, zero, cut(combine(1 / beta, r, 0.0, r)) if beta else zero, zero, zero
    c_old, c, s_old, s, eta, start, beta_in = 1.0, 1.0, 0.0, 0.0, beta, beta, 0.0
    for _ in range(limit if beta else 0):
        av = cut(a.project(a.multiply(v)))
        alpha = dot(v, av)
        next_v = cut(combine(1.0, combine(1.0, av, -alpha, v), -beta_in, v_old))
        beta_out = dot(next_v, next_v) ** 0.5
        delta, eps, gamma = c * alpha - c_old * s * beta_in, s_old * beta_in, s * alpha + c_old * c * beta_in
        rho = (delta**2 + beta_out**2) ** 0.5
        c_old, s_old, c, s = c, s, delta / rho, beta_out / rho
        next_w = cut(combine(1 / rho, combine(1.0, combine(1.0, v, -gamma, w), -eps, w_old), 0.0, v))
        x, eta = cut(combine(1.0, x, c * eta, next_w)), -s * eta
        if abs(eta) <= tolerance * start or beta_out < 1e-14:
            break
        v_old, v, w_old, w, beta_in = v, cut(combine(1 / beta_out, next_v, 0.0, next_v)), w, next_w, beta_out
    return x
