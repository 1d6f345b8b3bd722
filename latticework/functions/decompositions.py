"""Matrix decompositions and other functions without a closed column form, as Arrow-fed UDFs.

Matrices are row-major arrays. Signs and orders are fixed: singular and eigen
values descend, and each singular or eigen vector's largest part is positive.
"""

from __future__ import annotations

from fractions import Fraction
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def column_function(kind: str):
    """A function of columns from one of pandas series; the UDF is made when it is used,
    since that needs a session."""

    def wrap(f):
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap


def _stack(m: pd.Series) -> np.ndarray:
    flat = np.array(m.tolist(), dtype=float)
    n = int(round(flat.shape[1] ** 0.5)) if flat.size else 0
    return flat.reshape(-1, n, n)


@column_function("array<double>")
def singular_values(m: pd.Series) -> pd.Series:
    return pd.Series(np.linalg.svd(_stack(m), compute_uv=False).tolist())


@column_function("array<double>")
def eigenvalues(m: pd.Series) -> pd.Series:
    """Of symmetric matrices."""
    return pd.Series(np.linalg.eigvalsh(_stack(m))[:, ::-1].tolist())


@column_function("struct<rotation:array<double>,stretch:array<double>>")
def polar(m: pd.Series) -> pd.DataFrame:
    a = _stack(m)
    u, s, vt = np.linalg.svd(a)
    r = u @ vt
    stretch = np.swapaxes(vt, 1, 2) @ (s[:, :, None] * vt)
    return pd.DataFrame({"rotation": r.reshape(len(a), -1).tolist(), "stretch": stretch.reshape(len(a), -1).tolist()})


@column_function("struct<q:array<double>,r:array<double>>")
def qr(m: pd.Series) -> pd.DataFrame:
    a = _stack(m)
    q, r = np.linalg.qr(a)
    sign = np.where(np.diagonal(r, axis1=1, axis2=2) < 0, -1.0, 1.0)
    return pd.DataFrame({"q": (q * sign[:, None, :]).reshape(len(a), -1).tolist(), "r": (r * sign[:, :, None]).reshape(len(a), -1).tolist()})


@column_function("array<double>")
def make_positive(m: pd.Series) -> pd.Series:
    """Symmetric matrices with negative eigenvalues raised to 0."""
    w, v = np.linalg.eigh(_stack(m))
    out = (v * np.maximum(w, 0)[:, None, :]) @ np.swapaxes(v, 1, 2)
    return pd.Series(out.reshape(len(out), -1).tolist())


@column_function("array<double>")
def inverse(m: pd.Series) -> pd.Series:
    a = _stack(m)
    return pd.Series(np.linalg.inv(a).reshape(len(a), -1).tolist())


def _exact_signs(value: np.ndarray, bound: np.ndarray, exact) -> pd.Series:
    """Signs of determinants; those within their rounding error are found again in fractions."""
    out = np.sign(value).astype(np.int32)
    for k in np.flatnonzero(np.abs(value) <= bound):
        v = exact(int(k))
        out[k] = (v > 0) - (v < 0)
    return pd.Series(out)


@column_function("int")
def orient2d(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
    """Exact side of c from the line a-b: 1 left, -1 right, 0 on it."""
    p = [x.to_numpy(dtype=float) for x in (ax, ay, bx, by, cx, cy)]
    left, right = (p[0] - p[4]) * (p[3] - p[5]), (p[1] - p[5]) * (p[2] - p[4])

    def exact(k: int):
        a, b, c, d, e, f = (Fraction(float(x[k])) for x in p)
        return (a - e) * (d - f) - (b - f) * (c - e)

    return _exact_signs(left - right, 1e-15 * (np.abs(left) + np.abs(right)), exact)


@column_function("int")
def orient3d(ax: pd.Series, ay: pd.Series, az: pd.Series, bx: pd.Series, by: pd.Series, bz: pd.Series, cx: pd.Series, cy: pd.Series, cz: pd.Series, dx: pd.Series, dy: pd.Series, dz: pd.Series) -> pd.Series:
    """Exact side of d from the plane a-b-c: 1 where (b - a) x (c - a) points, -1 on the other side, 0 in it."""
    p = np.array([x.to_numpy(dtype=float) for x in (ax, ay, az, bx, by, bz, cx, cy, cz, dx, dy, dz)])
    u, v, w = p[3:6] - p[0:3], p[6:9] - p[0:3], p[9:12] - p[0:3]
    parts = [w[i] * u[j] * v[k] for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))], [w[i] * u[k] * v[j] for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]

    def exact(k: int):
        q = [[Fraction(float(x)) for x in p[r : r + 3, k]] for r in (0, 3, 6, 9)]
        u, v, w = ([x - y for x, y in zip(r, q[0], strict=True)] for r in q[1:])
        return sum(w[i] * (u[j] * v[m] - u[m] * v[j]) for i, j, m in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))

    return _exact_signs(sum(parts[0]) - sum(parts[1]), 1e-14 * sum(np.abs(x) for x in (*parts[0], *parts[1])), exact)


@column_function("long")
def reinterpret_bits(x: pd.Series) -> pd.Series:
    """The 64 bits of a double as a long."""
    return pd.Series(x.to_numpy(dtype=float).view(np.int64))


@column_function("double")
def add_rounded_up(x: pd.Series, y: pd.Series) -> pd.Series:
    """x + y, rounded towards plus infinity."""
    a, b = x.to_numpy(dtype=float), y.to_numpy(dtype=float)
    s = a + b
    back = s - a
    error = (a - (s - back)) + (b - back)
    return pd.Series(np.where(error > 0, np.nextafter(s, np.inf), s))


def subtract_rounded_up(x, y):
    """x - y, rounded towards plus infinity."""
    return add_rounded_up(x, -y)


@column_function("array<string>")
def rational_sum(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact sum of two fractions written p/q, in lowest terms."""
    return pd.Series([[str(s.numerator), str(s.denominator)] for s in (Fraction(x) + Fraction(y) for x, y in zip(a, b, strict=True))])
