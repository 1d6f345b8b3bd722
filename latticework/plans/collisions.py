"""Queries: first contacts of moving points, faces and edges over all lines.

Where only the point moves against the face, contact is a fraction of whole numbers, and SQL has it exactly. General
motion needs roots of cubics, which SQL cannot decide; pytest compares it with brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collision
from .contact import POINTS, P, _cross, _dot, _minus, four_points, near
from .registry import query

_WHOLE = "SELECT id, " + ", ".join(f"(4 * {c}{k})::BIGINT AS {c}{k}" for c in "abcd" for k in range(3)) + f" FROM ({POINTS})"
A, B, C, D, R, N, Q = ([f"{c}{k}" for k in range(3)] for c in ("a", "b", "c", "d", "r", "n", "q"))
_MOVE = ["id % 5 - 2", "id % 3 - 1", "1"]
_FACE = _cross(_minus(B, A), _minus(C, A))
_STEP = f"SELECT *, {', '.join(f'{x} AS n{k}' for k, x in enumerate(_FACE))}, {', '.join(f'a{k} + b{k} - 2 * d{k} - ({_MOVE[k]}) AS r{k}' for k in range(3))} FROM ({_WHOLE})"
_RATE = f"SELECT *, {_dot(N, _minus(D, A))} AS h, {_dot(N, R)} AS f FROM ({_STEP})"
_AT = [f"(d{k} * f - h * r{k})" for k in range(3)]


def _left_of(x, y) -> str:
    rest = [f"({_AT[k]} - f * {x[k]})" for k in range(3)]
    return f"{_dot(N, _cross(_minus(y, x), rest))} * f >= 0"


_HIT = f"f <> 0 AND (-h * sign(f)) BETWEEN 0 AND abs(f) AND {' AND '.join(_left_of(x, y) for x, y in ((A, B), (B, C), (C, A)))}"
_UNCLEAR = f"({_dot(N, N)} = 0 OR (f = 0 AND h = 0))"


def _shown(df):
    return df.select("id", "meets", near(F.col("meets_at"), 9).alias("at"))


@query(f"SELECT id, CASE WHEN NOT {_UNCLEAR} THEN {_HIT} END AS meets, CASE WHEN NOT {_UNCLEAR} AND {_HIT} THEN round(-h::DOUBLE / f, 9) + 0.0 END AS at FROM ({_RATE})")
def sliding_face_collisions(spark, sf_dir):
    """Point d goes to a + b - d while the triangle a, b, c slides; null where the triangle has no area or the point
    moves in its plane, since the SQL has no fraction there (the operator decides these too)."""
    df = four_points(spark, sf_dir)
    slide = [F.col("id") % 5 - 2, F.col("id") % 3 - 1, F.lit(1)]
    moved = lambda p: [x + s / 4 for x, s in zip(P(p), slide, strict=True)]
    end = [[F.col(f"a{k}") + F.col(f"b{k}") - F.col(f"d{k}") for k in range(3)], *map(moved, "abc")]
    out = collision.vertex_face(df, [P("d"), P("a"), P("b"), P("c")], end, "meets")
    u, v, w = ([F.col(f"{x}{k}") - F.col(f"a{k}") for k in range(3)] for x in "bcd")
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    along = [x - y - z for x, y, z in zip(end[0], P("d"), [s / 4 for s in slide], strict=True)]
    flat, still, level = (sum((x * y for x, y in zip(p[1:], q[1:], strict=True)), p[0] * q[0]) == 0 for p, q in ((n, n), (n, along), (n, w)))
    clear = ~(flat | (still & level))
    return _shown(out.withColumn("meets", F.when(clear, F.col("meets"))).withColumn("meets_at", F.when(clear, F.col("meets_at"))))


@query()
def moving_face_collisions(spark, sf_dir):
    """Point d goes to the middle of a and c, while a goes to b, b to c and c to d."""
    middle = [(x + y) / 2 for x, y in zip(P("a"), P("c"), strict=True)]
    return _shown(collision.vertex_face(four_points(spark, sf_dir), [P("d"), P("a"), P("b"), P("c")], [middle, P("b"), P("c"), P("d")], "meets"))


@query()
def moving_edge_collisions(spark, sf_dir):
    """Edge a-b goes to b-c, edge c-d to d-a."""
    end = [P(c) for c in "bcda"]
    return _shown(collision.edge_edge(four_points(spark, sf_dir), [P(c) for c in "abcd"], end, "meets"))
