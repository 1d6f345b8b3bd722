"""Small matrices as lists of columns, row by row: inverses to 4x4, transforms, rotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import cross


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def row(m: list[Column], i: int, n: int) -> list[Column]:
    return m[i * n : (i + 1) * n]


def transpose(m: list[Column], n: int) -> list[Column]:
    return [m[j * n + i] for i in range(n) for j in range(n)]


def trace(m: list[Column], n: int) -> Column:
    return _sum([m[k * n + k] for k in range(n)])


def minor(m: list[Column], n: int, r: int, c: int) -> list[Column]:
    return [m[i * n + j] for i in range(n) for j in range(n) if i != r and j != c]


def determinant(m: list[Column], n: int) -> Column:
    """By the first row; n up to 4."""
    if n == 1:
        return m[0]
    if n == 2:
        return m[0] * m[3] - m[1] * m[2]
    return _sum([(m[j] if j % 2 == 0 else -m[j]) * determinant(minor(m, n, 0, j), n - 1) for j in range(n)])


def cofactors(m: list[Column], n: int) -> list[Column]:
    if n == 1:
        return [F.lit(1.0)]
    signed = lambda c, k: c if k % 2 == 0 else -c
    return [signed(determinant(minor(m, n, i, j), n - 1), i + j) for i in range(n) for j in range(n)]


def inverse(m: list[Column], n: int) -> list[Column]:
    """Transposed cofactors over the determinant; null if singular."""
    det = determinant(m, n)
    return [c / F.when(det != 0, det) for c in transpose(cofactors(m, n), n)]


def matmul(a: list[Column], b: list[Column], n: int) -> list[Column]:
    return [_sum([a[i * n + k] * b[k * n + j] for k in range(n)]) for i in range(n) for j in range(n)]


def times_vector(m: list[Column], x: list[Column]) -> list[Column]:
    n = len(x)
    return [_sum([m[i * n + k] * x[k] for k in range(n)]) for i in range(len(m) // n)]


def vector_times(x: list[Column], m: list[Column]) -> list[Column]:
    n = len(m) // len(x)
    return [_sum([x[k] * m[k * n + j] for k in range(len(x))]) for j in range(n)]


def columns_scaled(m: list[Column], d: list[Column]) -> list[Column]:
    """The matrix times a diagonal one."""
    return [x * d[k % len(d)] for k, x in enumerate(m)]


def dyadic(a: list[Column], b: list[Column]) -> list[Column]:
    return [x * y for x in a for y in b]


def cross_matrix(a: list[Column]) -> list[Column]:
    """The matrix whose product with x is a cross x."""
    zero = F.lit(0.0)
    return [zero, -a[2], a[1], a[2], zero, -a[0], -a[1], a[0], zero]


def symmetric_eigenvalues_2(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Of ((a, b), (b, c)), the larger one first."""
    mean, half = (a + c) / 2, (a - c) / 2
    root = F.sqrt(half * half + b * b)
    return mean + root, mean - root


def embed(r: list[Column]) -> list[Column]:
    """A 3x3 matrix as a 4x4 transform."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return [*r[0:3], zero, *r[3:6], zero, *r[6:9], zero, zero, zero, zero, one]


def translation(t: list[Column]) -> list[Column]:
    out = embed([F.lit(1.0 if k % 4 == 0 else 0.0) for k in range(9)])
    for k in range(3):
        out[4 * k + 3] = t[k]
    return out


def scaling(s: list[Column]) -> list[Column]:
    return embed([s[k // 4] if k % 4 == 0 else F.lit(0.0) for k in range(9)])


def pre_translate(m: list[Column], t: list[Column]) -> list[Column]:
    """First moved, then m."""
    return matmul(m, translation(t), 4)


def post_translate(m: list[Column], t: list[Column]) -> list[Column]:
    """First m, then moved."""
    return matmul(translation(t), m, 4)


def apply_affine(m: list[Column], p: list[Column]) -> list[Column]:
    return times_vector(m, [*p, F.lit(1.0)])[:3]


def decompose(m: list[Column]) -> tuple[list[Column], list[Column], list[Column]]:
    """(scales, rotation, translation) of a transform whose 3x3 part is a rotation times a positive diagonal matrix."""
    part = [m[4 * i + j] for i in range(3) for j in range(3)]
    size = [F.sqrt(_sum([part[3 * i + j] * part[3 * i + j] for i in range(3)])) for j in range(3)]
    turn = [part[k] / F.when(size[k % 3] != 0, size[k % 3]) for k in range(9)]
    return size, turn, [m[4 * i + 3] for i in range(3)]


def euler(x: Column, y: Column, z: Column) -> list[Column]:
    """Turned about the x axis, then y, then z."""
    cx, sx, cy, sy, cz, sz = F.cos(x), F.sin(x), F.cos(y), F.sin(y), F.cos(z), F.sin(z)
    return [cy * cz, sx * sy * cz - cx * sz, cx * sy * cz + sx * sz, cy * sz, sx * sy * sz + cx * cz, cx * sy * sz - sx * cz, -sy, sx * cy, cx * cy]


def quaternion_matrix(q: list[Column]) -> list[Column]:
    """Of a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]


def axis_angle(r: list[Column]) -> Column:
    """The angle, 0 to pi, of a rotation matrix."""
    s = [r[7] - r[5], r[2] - r[6], r[3] - r[1]]
    return F.atan2(F.sqrt(_sum([k * k for k in s])), trace(r, 3) - 1)


def turn_between(a: list[Column], b: list[Column]) -> list[Column]:
    """The matrix of the shortest turn of unit vector a to unit vector b, which are not opposite."""
    k = cross_matrix(cross(a, b))
    square = matmul(k, k, 3)
    c = _sum([x * y for x, y in zip(a, b, strict=True)])
    return [(1.0 if n % 4 == 0 else 0.0) + k[n] + square[n] / (1 + c) for n in range(9)]
