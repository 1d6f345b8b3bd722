"""Continuous collision of moving points with triangles, and of moving edges: whether and when they first meet.

Every point goes straight from its start to its end in times 0 to 1. Rows of small whole numbers over a power of two are
decided in whole numbers by batches (`functions.contacts`). Of the others and the unclear ones, those stay whose box of the
differences between the sides' points, widened for rounding, holds 0 in one of 2^ROUNDS ranges of time, and whose volume, which
vanishes when the points lie in a plane, may be 0 in these; they are decided in whole numbers one by one.
Nothing is shuffled, and no contact is missed or made up.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import roots as r
from ..functions.contacts import first_contacts

#: Halvings of the time before a row is decided one by one; a row that is ruled out earlier has no ranges left.
ROUNDS = 4
#: Rows of a batch, whose arrays stay in the processor's caches.
BATCH = 2048


def _cross(a, b):
    return [r.minus(r.times(a[i], b[j]), r.times(a[j], b[i])) for i, j in ((1, 2), (2, 0), (0, 1))]


def _dot(a, b):
    out: list = []
    for x, y in zip(a, b, strict=True):
        out = r.plus(out, r.times(x, y))
    return out


def _sub(a, b):
    return [r.minus(x, y) for x, y in zip(a, b, strict=True)]


def _on_segment(p, x, y):
    """[polynomials that vanish], [polynomials that are not negative] while p is on the segment x-y."""
    return _cross(_sub(y, x), _sub(p, x)), [[-v for v in _dot(_sub(p, x), _sub(p, y))]]


def _point_in_triangle(p, a, b, c):
    n = _cross(_sub(b, a), _sub(c, a))
    return n, [_dot(n, _cross(_sub(y, x), _sub(p, x))) for x, y in ((a, b), (b, c), (c, a))], [(p, a, b), (p, b, c), (p, c, a)]


def _edges_cross(a, b, c, d):
    u, v, w = _sub(b, a), _sub(d, c), _sub(c, a)
    n = _cross(u, v)
    s, t, whole = _dot(_cross(w, v), n), _dot(_cross(w, u), n), _dot(n, n)
    return n, [s, r.minus(whole, s), t, r.minus(whole, t)], [(a, c, d), (b, c, d), (c, a, b), (d, a, b)]


def _first_contact(numbers, face: bool) -> float | None:
    """Time of the first contact of four points, starts then ends, 24 numbers."""
    exact = [Fraction(x) for x in numbers]
    unit = max(x.denominator for x in exact)
    whole = [int(x * unit) for x in exact]
    a, b, c, d = ([r.trim([whole[3 * k + i], whole[12 + 3 * k + i] - whole[3 * k + i]]) for i in range(3)] for k in range(4))
    volume = _dot(_sub(b, a), _cross(_sub(c, a), _sub(d, a)))
    normal, bounds, ends = (_point_in_triangle if face else _edges_cross)(a, b, c, d)

    def meets(root: r.Root) -> bool:
        if any(root.sign(x) for x in normal):
            return all(root.sign(x) >= 0 for x in bounds)
        return any(not any(root.sign(x) for x in zero) and all(root.sign(x) >= 0 for x in rest) for zero, rest in (_on_segment(*e) for e in ends))

    if volume:
        return next((t.place() for t in r.in_unit_range(volume) if meets(t)), None)
    # In one plane throughout: contact begins at once or where an end comes onto a segment. Each end has its own roots, since
    # those of a product of all take far longer chains.
    if meets(r.Root(None, Fraction(0), Fraction(0))):
        return 0.0
    asked = {tuple(x) for x in (next((z for z in zero if z), rest[0]) for zero, rest in (_on_segment(*e) for e in ends)) if len(x) > 1}
    return min((t.place() for x in asked for t in r.in_unit_range(list(x)) if meets(t)), default=None)


def _may_meet(x, face: bool):
    """Rows whose box of differences holds 0 in some of 2^ROUNDS ranges of time, and whose volume may be 0 in these.

    Numbers above 1e100 are kept, since products overflow."""
    start, end = x[:, :12].reshape(-1, 4, 3), x[:, 12:].reshape(-1, 4, 3)
    plain = np.abs(x).max(axis=1) < 1e100
    start, end = np.where(plain[:, None, None], start, 0), np.where(plain[:, None, None], end, 0)
    slack = (np.abs(start) + np.abs(end)).sum(axis=1) * 2.0**-48
    sides = ([0], [1, 2, 3]) if face else ([0, 1], [2, 3])
    lo, hi = np.full(len(x), 2.0), np.full(len(x), -1.0)
    parts, width = 2**ROUNDS, 0.5**ROUNDS
    for k in range(parts):
        ok = np.ones(len(x), bool)
        for i in range(3):
            gaps = [(start[:, q, i] - start[:, p, i]) + t * ((end[:, q, i] - end[:, p, i]) - (start[:, q, i] - start[:, p, i])) for p in sides[0] for q in sides[1] for t in (k * width, (k + 1) * width)]
            ok &= (np.min(gaps, axis=0) <= slack[:, i]) & (np.max(gaps, axis=0) >= -slack[:, i])
        lo, hi = np.where(ok, np.minimum(lo, k * width), lo), np.where(ok, (k + 1) * width, hi)
    seen = lo <= hi
    lo, hi = np.where(seen, lo, 0), np.where(seen, hi, 0)
    place = lambda t, k: start[:, k] + t[:, None] * (end[:, k] - start[:, k])
    ends = [[place(t, k) - place(t, 0) for k in (1, 2, 3)] for t in (lo, hi)]
    v = [np.einsum("ij,ij->i", ends[m & 1][0], np.cross(ends[m >> 1 & 1][1], ends[m >> 2 & 1][2])) for m in range(8)]
    corners = [v[0], (v[1] + v[2] + v[4]) / 3, (v[3] + v[5] + v[6]) / 3, v[7]]
    bound = slack.max(axis=1) ** 3 * 2.0**104 + 1e-300  # sizes cubed, by a factor above all rounding of a volume
    off = (np.min(corners, axis=0) > bound) | (np.max(corners, axis=0) < -bound)
    return ~plain | (seen & ~off)


def _decided(face: bool):
    @F.pandas_udf("double")
    def decide(rows: pd.Series) -> pd.Series:
        out = np.full(len(rows), np.nan)
        asked, values = np.flatnonzero(rows.notna().to_numpy()), rows.to_numpy()
        hard = []
        for part in np.array_split(asked, -(-len(asked) // BATCH) or 1):
            if not len(part):
                continue
            x = np.stack(values[part])
            out[part], decided = first_contacts(x, face)
            hard.append(part[~decided])
        left = np.concatenate(hard) if hard else asked
        if len(left):  # the filter is many small steps: it runs once for all of them
            x = np.stack(values[left])
            for k in np.flatnonzero(_may_meet(x, face)):
                t = _first_contact(x[k].tolist(), face)
                out[left[k]] = np.nan if t is None else t
        return pd.Series(out)

    return decide


def _contact(df: DataFrame, start, end, out: str, face: bool) -> DataFrame:
    names = [f"__at{k}" for k in range(24)]
    own = [c for c in df.columns if c not in (out, f"{out}_at")]
    df = df.select(*own, *[x.cast("double").alias(n) for n, x in zip(names, [x for p in (*start, *end) for x in p], strict=True)])
    finite = F.lit(True)
    for n in names:
        finite = finite & F.coalesce(F.abs(F.col(n)) < F.lit(float("inf")), F.lit(False))
    df = df.select(*own, finite.alias("__finite"), F.array(*[F.col(n) for n in names]).alias("__row"))
    df = df.select(*own, "__finite", _decided(face)(F.when(F.col("__finite"), F.col("__row"))).alias("__first"))
    return df.select(*own, F.when(F.col("__finite"), F.col("__first").isNotNull()).alias(out), F.col("__first").alias(f"{out}_at"))


def vertex_face(df: DataFrame, start: list[list[Column]], end: list[list[Column]], out: str) -> DataFrame:
    """df with `out`, whether the point `start`[0] -> `end`[0] meets the triangle of the other three while all move, and
    `out`_at, the first time (within 2^-52; null where they do not).

    Touching counts, also of a triangle that has no area at the time, and of points that stay in one plane. Rows: one
    for each of df's; one with a null or non-finite coordinate has nulls. Columns of df with the results' names are replaced."""
    return _contact(df, start, end, out, True)


def edge_edge(df: DataFrame, start: list[list[Column]], end: list[list[Column]], out: str) -> DataFrame:
    """As `vertex_face`, for the edge of the first two points and the edge of the last two; an edge may be a point."""
    return _contact(df, start, end, out, False)
