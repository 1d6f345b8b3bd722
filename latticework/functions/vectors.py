"""Small vectors and matrices in array columns, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def prod(v: Column) -> Column:
    return F.aggregate(v, F.lit(1.0), lambda a, x: a * x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def inf_norm(v: Column) -> Column:
    return F.array_max(F.transform(v, F.abs))


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x / n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, k: Column) -> Column:
    return F.transform(v, lambda x: x * k)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def determinant(m: list[Column]) -> Column:
    """Of a 2x2 or 3x3 matrix, row by row."""
    if len(m) == 4:
        return m[0] * m[3] - m[1] * m[2]
    c = cross(m[3:6], m[6:9])
    return m[0] * c[0] + m[1] * c[1] + m[2] * c[2]


def inverse(m: list[Column]) -> list[Column]:
    """Of a 3x3 matrix: rows of cross products over the determinant; null if singular."""
    det = F.when(determinant(m) != 0, determinant(m))
    a, b, c = m[0:3], m[3:6], m[6:9]
    columns = [cross(b, c), cross(c, a), cross(a, b)]
    return [columns[j][i] / det for i in range(3) for j in range(3)]


def matmul(a: list[Column], b: list[Column], n: int = 3) -> list[Column]:
    return [sum((a[i * n + k] * b[k * n + j] for k in range(1, n)), a[i * n] * b[j]) for i in range(n) for j in range(n)]


def rotation(axis: list[Column], angle: Column) -> list[Column]:
    """3x3 matrix of a turn about a unit axis."""
    c, s = F.cos(angle), F.sin(angle)
    x, y, z = axis
    k = 1 - c
    return [c + x * x * k, x * y * k - z * s, x * z * k + y * s, y * x * k + z * s, c + y * y * k, y * z * k - x * s, z * x * k - y * s, z * y * k + x * s, c + z * z * k]


def quaternion_multiply(a: list[Column], b: list[Column]) -> list[Column]:
    """Of (w, x, y, z)."""
    w, v, w2, v2 = a[0], a[1:], b[0], b[1:]
    c = cross(v, v2)
    return [w * w2 - v[0] * v2[0] - v[1] * v2[1] - v[2] * v2[2], *[w * v2[k] + w2 * v[k] + c[k] for k in range(3)]]


def bspline(fraction: Column, degree: int) -> list[Column]:
    """Weights of the degree + 1 nodes from the base node on, `fraction` being the place from it."""
    x = fraction
    if degree == 1:
        return [1 - x, x]
    if degree == 2:
        return [0.5 * (1.5 - x) * (1.5 - x), 0.75 - (x - 1) * (x - 1), 0.5 * (x - 0.5) * (x - 0.5)]
    y = x - 1  # in [0, 1): the place between the two middle nodes
    return [(1 - y) * (1 - y) * (1 - y) / 6, (3 * y * y * y - 6 * y * y + 4) / 6, (-3 * y * y * y + 3 * y * y + 3 * y + 1) / 6, y * y * y / 6]


def base_node(x: Column, degree: int) -> Column:
    return F.floor(x - 0.5 * (degree - 1)).cast("long")


def mapped(v: Column, f) -> Column:
    """Any function of an element, applied to all."""
    return F.transform(v, f)


def deviatoric(v: Column) -> Column:
    """Less its mean."""
    mean = total(v) / F.size(v)
    return F.transform(v, lambda x: x - mean)


def bspline_slope(x: Column) -> list[Column]:
    """Derivatives of the three quadratic weights by the place."""
    return [x - 1.5, -2 * (x - 1), x - 0.5]
