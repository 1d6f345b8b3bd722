"""Queries: distances between features, their gradients, contact terms, level sets and predicates over all lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.scalars import half_away
from ..operators import order
from .registry import Tables, query

#: Four points of a row from its columns, as (SQL, column): whole numbers over 4, so that sums are exact.
NAMES = "abcd"


def _coordinate(k: int, axis: int) -> tuple[str, str]:
    return f"(({['l_quantity', 'l_orderkey', 'l_partkey', 'l_suppkey'][(k + axis) % 4]} * {3 + 2 * k + axis} + l_linenumber * {k + 1})::BIGINT % {23 + 4 * axis + k})", f"{NAMES[k]}{axis}"


POINTS = "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS id, " + ", ".join(f"{_coordinate(k, axis)[0]} / 4.0::DOUBLE AS {_coordinate(k, axis)[1]}" for k in range(4) for axis in range(3)) + " FROM lineitem"


def four_points(spark, sf_dir):
    """(id, a0 .. d2): all lines, numbered in a fixed order, each as four points."""
    own = ["l_quantity", "l_orderkey", "l_partkey", "l_suppkey"]
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    # Points are made of the numbered rows, so that the sort moves and writes their few columns only.
    rows = Tables(spark, sf_dir).lineitem.select(*keys, "l_quantity")
    placed = order.numbered(rows, *[F.col(c) for c in keys], out="id", rows=rows.count(), keep=[*own, "l_linenumber"])
    points = [(((F.col(own[(k + axis) % 4]) * (3 + 2 * k + axis) + F.col("l_linenumber") * (k + 1)).cast("long") % (23 + 4 * axis + k)) / F.lit(4.0)).alias(f"{NAMES[k]}{axis}") for k in range(4) for axis in range(3)]
    return placed.select("id", *points)


def P(name: str):  # noqa: N802
    return [F.col(f"{name}{axis}") for axis in range(3)]


def near(c, digits: int = 6):
    return half_away(c, digits) + F.lit(0.0)


def on_batches(rows, f, kinds: dict[str, str]):
    """id with the columns that `f` makes of the points' coordinates, in Arrow batches: arrays by point and axis, NaN for null both ways."""

    def run(batches):
        for batch in batches:
            at = {n: [batch.column(f"{n}{axis}").to_numpy(zero_copy_only=False) for axis in range(3)] for n in NAMES}
            with np.errstate(all="ignore"):
                made = f(at)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(made[c], from_pandas=True) for c in kinds]], names=["id", *kinds])

    return rows.mapInArrow(run, "id long, " + ", ".join(f"{c} {kind}" for c, kind in kinds.items()))


def rounded(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + 0.0"


def _dot(a, b):
    return "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(a, b, strict=True)) + ")"


def _minus(a, b):
    return [f"({x} - {y})" for x, y in zip(a, b, strict=True)]


def _cross(a, b):
    return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]


def S(name: str) -> list[str]:  # noqa: N802
    return [f"{name}{axis}" for axis in range(3)]


def _segment(p, a, b):
    ab, ap = _minus(b, a), _minus(p, a)
    t = f"(CASE WHEN {_dot(ab, ab)} = 0 THEN 0 ELSE least(greatest({_dot(ap, ab)} / {_dot(ab, ab)}, 0), 1) END)"
    d = [f"({x} - {t} * {y})" for x, y in zip(ap, ab, strict=True)]
    return _dot(d, d)


A, B, C, D = (S(n) for n in NAMES)
PLANE_N = _cross(_minus(B, A), _minus(C, A))
LINES_N = _cross(_minus(B, A), _minus(D, C))


@query(f"SELECT id, {rounded(_dot(_minus(A, B), _minus(A, B)))} AS points, CASE WHEN {_dot(_minus(C, B), _minus(C, B))} > 0 THEN {rounded(f'{_dot(_cross(_minus(B, A), _minus(C, A)), _cross(_minus(B, A), _minus(C, A)))} / {_dot(_minus(C, B), _minus(C, B))}')} END AS line, {rounded(_segment(A, B, C))} AS segment, CASE WHEN {_dot(PLANE_N, PLANE_N)} > 0 THEN {rounded(f'{_dot(_minus(D, A), PLANE_N)} * {_dot(_minus(D, A), PLANE_N)} / {_dot(PLANE_N, PLANE_N)}')} END AS plane, CASE WHEN {_dot(LINES_N, LINES_N)} > 0 THEN {rounded(f'{_dot(_minus(C, A), LINES_N)} * {_dot(_minus(C, A), LINES_N)} / {_dot(LINES_N, LINES_N)}')} END AS lines, CASE WHEN {_dot(_minus(C, B), _minus(C, B))} = 0 OR {_dot(_minus(A, B), _minus(C, B))} <= 0 THEN 0 WHEN {_dot(_minus(A, B), _minus(C, B))} >= {_dot(_minus(C, B), _minus(C, B))} THEN 1 ELSE 2 END AS side FROM ({POINTS})")
def feature_distances(spark, sf_dir):
    return four_points(spark, sf_dir).select("id", near(g.point_point_squared(P("a"), P("b"))).alias("points"), near(g.point_line_squared(P("a"), P("b"), P("c"))).alias("line"), near(g.point_segment_squared(P("a"), P("b"), P("c"))).alias("segment"), near(g.point_plane_squared(P("d"), P("a"), P("b"), P("c"))).alias("plane"), near(g.line_line_squared(*map(P, "abcd"))).alias("lines"), g.point_edge_case(*map(P, "abc")).alias("side"))


def _inside(p, a, b, c):
    n = _cross(_minus(b, a), _minus(c, a))
    return " AND ".join(f"{_dot(_cross(_minus(y, x), _minus(p, x)), n)} >= 0" for x, y in ((a, b), (b, c), (c, a))) + f" AND {_dot(n, n)} > 0"


ENDS = f"least({_segment(A, C, D)}, {_segment(B, C, D)}, {_segment(C, A, B)}, {_segment(D, A, B)})"
_U, _V, _W = _minus(B, A), _minus(D, C), _minus(A, C)
_DET = f"({_dot(_U, _U)} * {_dot(_V, _V)} - {_dot(_U, _V)} * {_dot(_U, _V)})"
_SS, _TT = f"({_dot(_U, _V)} * {_dot(_V, _W)} - {_dot(_V, _V)} * {_dot(_U, _W)})", f"({_dot(_U, _U)} * {_dot(_V, _W)} - {_dot(_U, _V)} * {_dot(_U, _W)})"


@query(f"SELECT id, {rounded(f'CASE WHEN {_inside(D, A, B, C)} THEN {_dot(_minus(D, A), PLANE_N)} * {_dot(_minus(D, A), PLANE_N)} / {_dot(PLANE_N, PLANE_N)} ELSE least({_segment(D, A, B)}, {_segment(D, B, C)}, {_segment(D, C, A)}) END', 5)} AS triangle, {rounded(f'CASE WHEN {_DET} > 0 AND {_SS} BETWEEN 0 AND {_DET} AND {_TT} BETWEEN 0 AND {_DET} THEN {_dot(_minus(C, A), LINES_N)} * {_dot(_minus(C, A), LINES_N)} / {_dot(LINES_N, LINES_N)} ELSE {ENDS} END', 5)} AS segments FROM ({POINTS})")
def closest_features(spark, sf_dir):
    def found(at):
        a, b, c, d = (at[n] for n in NAMES)
        return {"triangle": half_away(g.point_triangle_squared(d, a, b, c), 5) + 0.0, "segments": half_away(g.segment_segment_squared(a, b, c, d), 5) + 0.0}

    return on_batches(four_points(spark, sf_dir), found, {"triangle": "double", "segments": "double"})



FINE = f"({_dot(PLANE_N, PLANE_N)} > 9 AND {_dot(LINES_N, LINES_N)} > 9 AND {_dot(_minus(C, B), _minus(C, B))} > 1)"


@query(f"SELECT id, {FINE} AS fine, true AS points, true AS line, true AS plane, true AS lines FROM ({POINTS})")
def gradient_errors(spark, sf_dir):
    """Each analytic gradient against the central difference of its distance along a slanting direction, row by row:
    true where they agree, for rows whose features are not degenerate."""
    h = 2.0**-12
    cases = {
        "points": (g.point_point_squared, g.point_point_gradient, "ab"), "line": (g.point_line_squared, g.point_line_gradient, "abc"),
        "plane": (g.point_plane_squared, g.point_plane_gradient, "dabc"), "lines": (g.line_line_squared, g.line_line_gradient, "abcd"),
    }

    def errors(at):
        n = g.cross(g.minus(at["b"], at["a"]), g.minus(at["c"], at["a"]))
        fine = (g.dot(n, n) > 9) & (g.edges_cross_squared(*(at[c] for c in NAMES)) > 9) & (g.point_point_squared(at["b"], at["c"]) > 1)
        lost = np.any([np.isnan(x) for c in NAMES for x in at[c]], axis=0)
        out = {"fine": np.ma.masked_array(fine, lost)}
        for name, (value, gradient, points) in cases.items():
            along = [[0.5 - 0.375 * k + 0.25 * axis * (k + 1) for axis in range(3)] for k in range(len(points))]
            high, low = ([[x + sign * h * along[k][axis] for axis, x in enumerate(at[m])] for k, m in enumerate(points)] for sign in (1, -1))
            slope = sum(x * y for x, y in zip(gradient(*(at[m] for m in points)), [x for part in along for x in part], strict=True))
            rise = (value(*high) - value(*low)) / (2 * h)
            out[name] = ~fine | (np.abs(slope - rise) <= 1e-3 * (1 + np.abs(slope)))
        return out

    return on_batches(four_points(spark, sf_dir), errors, {"fine": "boolean"} | dict.fromkeys(cases, "boolean"))



D2 = "(id % 100 + 1) / 100.0::DOUBLE"


@query(f"SELECT id, {rounded(f'CASE WHEN d2 < 0.64 THEN -3 * (d2 - 0.64) * (d2 - 0.64) * ln(d2 / 0.64) ELSE 0 END', 9)} AS energy, {rounded('CASE WHEN d2 < 0.64 THEN 3 * ((d2 - 0.64) * ln(d2 / 0.64) * -2 - (d2 - 0.64) * (d2 - 0.64) / d2) ELSE 0 END', 9)} AS slope, {rounded('CASE WHEN d2 < 0.64 THEN 3 * (ln(d2 / 0.64) * -2 - (d2 - 0.64) * 4 / d2 + ((d2 - 0.64) / d2) * ((d2 - 0.64) / d2)) ELSE 0 END', 7)} AS curve, {rounded('CASE WHEN d2 < 0.5 THEN (2 - d2 / 0.5) * d2 / 0.5 ELSE 1 END', 9)} AS soft, {rounded('CASE WHEN d2 < 0.5 THEN 2 * (1 - d2 / 0.5) / 0.5 ELSE 0 END', 9)} AS soft_slope, CASE WHEN d2 < 0.5 THEN -8.0 ELSE 0.0 END::DOUBLE AS soft_curve, {rounded('CASE WHEN d2 >= 0.09 THEN sqrt(d2) ELSE d2 * (0.3 - sqrt(d2) / 3) / 0.09 + 0.1 END', 9)} AS f0, {rounded('CASE WHEN d2 >= 0.09 THEN 1 / sqrt(d2) ELSE (0.6 - sqrt(d2)) / 0.09 END', 9)} AS f1 FROM (SELECT id, {D2} AS d2 FROM (SELECT p_partkey::BIGINT AS id FROM part))")
def barrier_derivatives(spark, sf_dir):
    d2 = (F.col("id") % 100 + 1) / F.lit(100.0)
    reach, k, eps = F.lit(0.64), F.lit(3.0), F.lit(0.3)
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id")).select("id", near(g.barrier(d2, reach, k), 9).alias("energy"), near(g.barrier_gradient(d2, reach, k), 9).alias("slope"), near(g.barrier_hessian(d2, reach, k), 7).alias("curve"), near(g.mollifier(d2, F.lit(0.5)), 9).alias("soft"), near(g.mollifier_slope(d2, F.lit(0.5)), 9).alias("soft_slope"), g.mollifier_curve(d2, F.lit(0.5)).alias("soft_curve"), near(g.friction_f0(F.sqrt(d2), eps), 9).alias("f0"), near(g.friction_f1(d2, eps), 9).alias("f1"))


_UNIT = f"SELECT id, u0 / l AS u0, u1 / l AS u1, u2 / l AS u2 FROM (SELECT *, nullif(sqrt({_dot(['u0', 'u1', 'u2'], ['u0', 'u1', 'u2'])}), 0) AS l FROM (SELECT id, {', '.join(f'{x} AS u{k}' for k, x in enumerate(PLANE_N))} FROM ({POINTS})))"
_OTHER = f"SELECT *, CASE WHEN abs(u0) > 0.5 THEN -u1 / sqrt(u0 * u0 + u1 * u1) ELSE 0 END AS o0, CASE WHEN abs(u0) > 0.5 THEN u0 / sqrt(u0 * u0 + u1 * u1) ELSE -u2 / sqrt(u1 * u1 + u2 * u2) END AS o1, CASE WHEN abs(u0) > 0.5 THEN 0 ELSE u1 / sqrt(u1 * u1 + u2 * u2) END AS o2 FROM ({_UNIT}) WHERE u0 IS NOT NULL"


@query(f"SELECT id, {', '.join(f'{rounded(x)} AS {n}' for n, x in zip(['s0', 's1', 's2', 't0', 't1', 't2'], ['o0', 'o1', 'o2', *_cross(['u0', 'u1', 'u2'], ['o0', 'o1', 'o2'])], strict=True))}, {rounded('-16.0 / ((id % 7 + 1) * (id % 7 + 1))')} AS f2 FROM ({_OTHER})")
def friction_frames(spark, sf_dir):
    """Two directions of sliding on each triangle that has an area, and the curvature of the smoothed friction there."""
    n = g.cross(g.minus(P("b"), P("a")), g.minus(P("c"), P("a")))
    size = F.sqrt(g.dot(n, n))
    df = four_points(spark, sf_dir).where(size > 0).select("id", *[(x / size).alias(f"u{k}") for k, x in enumerate(n)])
    s, t = g.tangent_basis(P("u"))
    eps = (F.col("id") % 7 + 1) / F.lit(4.0)
    return df.select("id", *[near(x).alias(f"s{k}") for k, x in enumerate(s)], *[near(x).alias(f"t{k}") for k, x in enumerate(t)], near(g.friction_f2(eps)).alias("f2"))


@query(f"SELECT id, {rounded(_dot(LINES_N, LINES_N))} AS crossed, {rounded(f'0.01 * {_dot(_minus(A, B), _minus(A, B))} * {_dot(_minus(C, D), _minus(C, D))} + 1e-9')} AS threshold FROM ({POINTS})")
def nearly_parallel_edges(spark, sf_dir):
    return four_points(spark, sf_dir).select("id", near(g.edges_cross_squared(*map(P, "abcd"))).alias("crossed"), near(g.mollifier_threshold(*map(P, "abcd")) + 1e-9).alias("threshold"))


_E1, _E2, _R = _minus(B, A), _minus(C, A), ["1.0", "0.5", "-0.25"]
_PV = _cross(_R, _E2)
_DETR = _dot(_E1, _PV)
_TV = _minus(D, A)
_QV = _cross(_TV, _E1)


@query(f"SELECT id, CASE WHEN dt <> 0 AND u / dt >= 0 AND v / dt >= 0 AND (u + v) / dt <= 1 THEN {rounded('t / dt', 6)} END AS at FROM (SELECT id, {_DETR} AS dt, {_dot(_TV, _PV)} AS u, {_dot(_R, _QV)} AS v, {_dot(_E2, _QV)} AS t FROM ({POINTS}))")
def rays_and_triangles(spark, sf_dir):
    """Distance at which a ray from d meets the triangle a, b, c."""
    ray = [F.lit(1.0), F.lit(0.5), F.lit(-0.25)]
    return four_points(spark, sf_dir).select("id", near(g.ray_triangle(P("d"), ray, *map(P, "abc"), eps=1e-12)).alias("at"))


_SEG = _minus(["a0 + 6", "b1", "c2"], D)
_PVS = _cross(_SEG, _E2)


@query(f"SELECT id, coalesce(dt <> 0 AND u / dt >= -1e-14 AND v / dt >= -1e-14 AND (u + v) / dt <= 1 + 1e-14 AND t / dt BETWEEN 0 AND 1, false) AS meets FROM (SELECT id, nullif({_dot(_E1, _PVS)}, 0) AS dt, {_dot(_TV, _PVS)} AS u, {_dot(_SEG, _QV)} AS v, {_dot(_E2, _QV)} AS t FROM ({POINTS}))")
def edges_and_triangles(spark, sf_dir):
    end = [F.col("a0") + 6, F.col("b1"), F.col("c2")]
    return four_points(spark, sf_dir).select("id", g.edge_triangle(P("d"), end, *map(P, "abc")).alias("meets"))


def _swept(names, pad):
    low = [f"least({', '.join(f'{n}{k}, {n}{k} + 0.5 * (d{k} - {n}{k}) / 4' for n in names)}) - {pad}" for k in range(3)]
    high = [f"greatest({', '.join(f'{n}{k}, {n}{k} + 0.5 * (d{k} - {n}{k}) / 4' for n in names)}) + {pad}" for k in range(3)]
    return low, high


_LA, _HA = _swept("a", "0.125")
_LB, _HB = _swept("bc", "0")


@query(f"SELECT id, {' AND '.join(f'({_LA[k]}) <= ({_HB[k]}) AND ({_HA[k]}) >= ({_LB[k]})' for k in range(3))} AS near_in_time FROM ({POINTS})")
def swept_boxes(spark, sf_dir):
    """Point a against edge b-c, all drawn towards d, over half a step."""
    pull = lambda n: g.scaled(g.minus(P("d"), P(n)), F.lit(0.25))
    return four_points(spark, sf_dir).select("id", g.ccd_broad_phase([P("a")], [pull("a")], [P("b"), P("c")], [pull("b"), pull("c")], F.lit(0.125), F.lit(0.5)).alias("near_in_time"))


_SPHERE = "(sqrt((a0 - 2) * (a0 - 2) + (a1 - 2) * (a1 - 2) + (a2 - 2) * (a2 - 2)) - 1.5)"
_TORUS = "(sqrt(pow(sqrt((a0 - 3) * (a0 - 3) + (a2 - 3) * (a2 - 3)) - 2, 2) + (a1 - 3) * (a1 - 3)) - 0.5)"


@query(f"SELECT id, {rounded(_TORUS)} AS ring, {rounded(f'least({_SPHERE}, {_TORUS})')} AS either, {rounded(f'greatest({_SPHERE}, {_TORUS})')} AS both, {rounded(f'greatest({_SPHERE}, -{_TORUS})')} AS without, {rounded(f'{_SPHERE} + ({_TORUS} - {_SPHERE}) * 0.25')} AS between FROM ({POINTS})")
def composite_level_sets(spark, sf_dir):
    a = P("a")
    s, t = g.sphere(a, [F.lit(2.0)] * 3, F.lit(1.5)), g.torus(a, [F.lit(3.0)] * 3, F.lit(2.0), F.lit(0.5))
    return four_points(spark, sf_dir).select("id", near(t).alias("ring"), near(g.union(s, t)).alias("either"), near(g.intersection(s, t)).alias("both"), near(g.difference(s, t)).alias("without"), near(g.transition(s, t, F.lit(0.25))).alias("between"))


_IN = "(a0 < 3 AND a1 < 3)"


@query(f"SELECT id, {rounded(f'CASE WHEN {_IN} THEN 1 + 0.5 * (a2 - 2) - 0.25 * (a1 - 2) ELSE b0 END')} AS vx, {rounded(f'CASE WHEN {_IN} THEN 0.25 * (a0 - 2) - 0 * (a2 - 2) ELSE b1 END')} AS vy, {rounded('1 + 0.5 * (a2 - 2) - 0.25 * (a1 - 2)')} AS rx FROM ({POINTS})")
def sticky_collider(spark, sf_dir):
    """Velocity b inside a body that moves along x and turns about y and z takes the body's."""
    body = g.rigid_velocity(P("a"), [F.lit(2.0)] * 3, [F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.5), F.lit(0.25)])
    v = g.collide_sticky(P("b"), body, (F.col("a0") < 3) & (F.col("a1") < 3))
    return four_points(spark, sf_dir).select("id", near(v[0]).alias("vx"), near(v[1]).alias("vy"), near(body[0]).alias("rx"))


def _turn(a, b, c):
    return f"sign(({b}0 - {a}0) * ({c}1 - {a}1) - ({b}1 - {a}1) * ({c}0 - {a}0))"


def _on(p, a, b):
    return f"({_turn(a, b, p)} = 0 AND {p}0 BETWEEN least({a}0, {b}0) AND greatest({a}0, {b}0) AND {p}1 BETWEEN least({a}1, {b}1) AND greatest({a}1, {b}1))"


_T3 = [_turn("a", "b", "d"), _turn("b", "c", "d"), _turn("c", "a", "d")]


@query(f"SELECT id, {_turn('a', 'b', 'c')}::INTEGER AS turn, {_on('c', 'a', 'b')} AS on_it, ({_turn('a', 'b', 'c')} * {_turn('a', 'b', 'd')} < 0 AND {_turn('c', 'd', 'a')} * {_turn('c', 'd', 'b')} < 0) OR {_on('c', 'a', 'b')} OR {_on('d', 'a', 'b')} OR {_on('a', 'c', 'd')} OR {_on('b', 'c', 'd')} AS meet, CASE WHEN {_turn('a', 'b', 'c')} = 0 THEN {_on('d', 'a', 'b')} OR {_on('d', 'b', 'c')} OR {_on('d', 'c', 'a')} ELSE least({', '.join(_T3)}) >= 0 OR greatest({', '.join(_T3)}) <= 0 END AS in_triangle, {_dot(PLANE_N, PLANE_N)} = 0 AS flat FROM ({POINTS})")
def planar_predicates(spark, sf_dir):
    a, b, c, d = (P(n)[:2] for n in NAMES)
    return four_points(spark, sf_dir).select("id", g.orient_2d(a, b, c).alias("turn"), g.on_segment_2d(c, a, b).alias("on_it"), g.segments_meet_2d(a, b, c, d).alias("meet"), g.in_triangle_2d(d, a, b, c).alias("in_triangle"), g.degenerate_triangle(*map(P, "abc")).alias("flat"))


def _side(q, x, y, z):
    return _dot(_minus(q, x), _cross(_minus(y, x), _minus(z, x)))


_Q = ["2.0", "2.5", "3.0"]


@query(f"SELECT id, {' AND '.join(f'{_side(_Q, x, y, z)} * {_side(o, x, y, z)} >= 0' for x, y, z, o in ((A, B, C, D), (B, C, D, A), (C, D, A, B), (D, A, B, C)))} AS inside, sign({_side(D, A, B, C)})::INTEGER AS orientation FROM ({POINTS})")
def point_in_tetrahedron(spark, sf_dir):
    from ..functions import decompositions as d

    q = [F.lit(2.0), F.lit(2.5), F.lit(3.0)]
    return four_points(spark, sf_dir).select("id", g.in_tetrahedron(q, *map(P, "abcd")).alias("inside"), d.orient3d(*P("a"), *P("b"), *P("c"), *P("d")).alias("orientation"))
