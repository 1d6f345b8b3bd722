"""Distances, level sets, intersections and contact terms as column expressions.

Distances between features and their gradients also take numpy arrays, with NaN for null: over whole tables, long projections are compiled
in methods too large for the JVM to optimise, so queries run them on Arrow batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _when(condition, x, y):
    return F.when(condition, x).otherwise(y) if isinstance(condition, Column) else np.where(condition, x, y)


def _least(*parts):
    return F.least(*parts) if isinstance(parts[0], Column) else np.fmin.reduce(parts)


def _listed(*parts):
    return F.array(*parts) if isinstance(parts[0], Column) else list(parts)


def minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return _sum([x * y for x, y in zip(a, b, strict=True)])


def boxes_overlap(low_a, high_a, low_b, high_b) -> Column:
    """Closed boxes."""
    out = F.lit(True)
    for a, b, c, d in zip(low_a, high_a, low_b, high_b, strict=True):
        out = out & (c <= b) & (d >= a)
    return out


def spheres_overlap(c1, r1: Column, c2, r2: Column) -> Column:
    return dot(minus(c1, c2), minus(c1, c2)) <= (r1 + r2) * (r1 + r2)


def box_distance(point, low, high) -> Column:
    """Signed: negative inside."""
    d = [F.greatest(a - p, p - b) for p, a, b in zip(point, low, high, strict=True)]
    return F.sqrt(_sum([F.greatest(x, F.lit(0.0)) * F.greatest(x, F.lit(0.0)) for x in d])) + F.least(F.greatest(*d), F.lit(0.0))


def plane(point, origin, normal) -> Column:
    return dot(minus(point, origin), normal)


def sphere(point, centre, radius: Column) -> Column:
    d = minus(point, centre)
    return F.sqrt(dot(d, d)) - radius


def cuboid(point, low, high) -> Column:
    return box_distance(point, low, high)


def cylinder(point, base, radius: Column, length: Column, axis: int = 1) -> Column:
    """Upright from its base along an axis."""
    d = minus(point, base)
    across = F.sqrt(_sum([d[k] * d[k] for k in range(3) if k != axis])) - radius
    along = F.greatest(-d[axis], d[axis] - length)
    outside = F.sqrt(F.greatest(across, F.lit(0.0)) * F.greatest(across, F.lit(0.0)) + F.greatest(along, F.lit(0.0)) * F.greatest(along, F.lit(0.0)))
    return outside + F.least(F.greatest(across, along), F.lit(0.0))


def ray_entry(origin, direction, low, high) -> Column:
    """How far along its direction a ray enters a box, by slabs, 0 from within, null if they do not meet; a zero part of the
    direction must lie inside its slab."""
    near, far, ok = [], [], F.lit(True)
    for o, d, a, b in zip(origin, direction, low, high, strict=True):
        flat = d == 0
        inv = F.lit(1.0) / F.when(flat, F.lit(1.0)).otherwise(d)
        t1, t2 = (a - o) * inv, (b - o) * inv
        near.append(F.when(flat, F.lit(-1e300)).otherwise(F.least(t1, t2)))
        far.append(F.when(flat, F.lit(1e300)).otherwise(F.greatest(t1, t2)))
        ok = ok & (~flat | ((o >= a) & (o <= b)))
    enter, leave = F.greatest(*near), F.least(*far)
    return F.when(ok & (leave >= enter) & (leave >= 0), F.greatest(enter, F.lit(0.0)))


def ray_box(origin, direction, low, high) -> Column:
    """Whether a ray meets a box."""
    return ray_entry(origin, direction, low, high).isNotNull()


def point_segment_squared(p, a, b) -> Column:
    ab, ap = minus(b, a), minus(p, a)
    length = dot(ab, ab)
    share = dot(ap, ab) / _when(length == 0, 1.0, length)
    inner = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) if isinstance(share, Column) else np.clip(share, 0.0, 1.0)
    t = _when(length == 0, 0.0, inner)
    d = [x - t * y for x, y in zip(ap, ab, strict=True)]
    return dot(d, d)


def barrier(d2: Column, reach2: Column, stiffness: Column) -> Column:
    near = (d2 < reach2) & (d2 > 0)
    safe = F.when(near, d2).otherwise(reach2)
    return F.when(near, -stiffness * (safe - reach2) * (safe - reach2) * F.log(safe / reach2)).otherwise(0.0)


def barrier_gradient(d2: Column, reach2: Column, stiffness: Column) -> Column:
    near = (d2 < reach2) & (d2 > 0)
    safe = F.when(near, d2).otherwise(reach2)
    t = safe - reach2
    return F.when(near, -stiffness * (2 * t * F.log(safe / reach2) + t * t / safe)).otherwise(0.0)


def mollifier(x: Column, threshold: Column) -> Column:
    r = x / threshold
    return F.when(x < threshold, (2 - r) * r).otherwise(1.0)


def friction_f0(x: Column, eps: Column) -> Column:
    """Smoothed friction potential."""
    return F.when(x >= eps, x).otherwise(x * x * (1 - x / (3 * eps)) / eps + eps / 3)


def collide_slip(velocity, normal, object_velocity, inside: Column) -> list[Column]:
    """Without its part along the normal where inside."""
    rel = minus(velocity, object_velocity)
    along = dot(rel, normal)
    return [F.when(inside, o + r - along * n).otherwise(v) for v, o, r, n in zip(velocity, object_velocity, rel, normal, strict=True)]


def collide_separate(velocity, normal, object_velocity, inside: Column) -> list[Column]:
    """As slip, but only while approaching."""
    rel = minus(velocity, object_velocity)
    along = dot(rel, normal)
    return [F.when(inside & (along < 0), o + r - along * n).otherwise(v) for v, o, r, n in zip(velocity, object_velocity, rel, normal, strict=True)]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def plus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x + y for x, y in zip(a, b, strict=True)]


def scaled(a: list[Column], k: Column) -> list[Column]:
    return [x * k for x in a]


def over(a, b):
    """a / b, null (NaN in arrays) where b is 0."""
    return a / (F.when(b != 0, b) if isinstance(b, Column) else np.where(b != 0, b, np.nan))


def point_point_squared(a, b) -> Column:
    return dot(minus(a, b), minus(a, b))


def point_line_squared(p, a, b) -> Column:
    """To the line through a and b."""
    n = cross(minus(a, p), minus(b, p)) if len(p) == 3 else [(a[0] - p[0]) * (b[1] - p[1]) - (a[1] - p[1]) * (b[0] - p[0])]
    return over(dot(n, n), point_point_squared(a, b))


def point_plane_squared(p, a, b, c) -> Column:
    """To the plane through a, b and c."""
    n = cross(minus(b, a), minus(c, a))
    height = dot(minus(p, a), n)
    return over(height * height, dot(n, n))


def line_line_squared(a, b, c, d) -> Column:
    """Between the lines a-b and c-d, which are not parallel."""
    n = cross(minus(b, a), minus(d, c))
    gap = dot(minus(c, a), n)
    return over(gap * gap, dot(n, n))


def point_edge_case(p, a, b) -> Column:
    """Nearest to 0: the first end, 1: the second one, 2: a place between."""
    t = over(dot(minus(p, a), minus(b, a)), point_point_squared(a, b))
    return F.when(t.isNull() | (t <= 0), 0).when(t >= 1, 1).otherwise(2)


def point_triangle_squared(p, a, b, c) -> Column:
    """To a triangle, whichever of its corners, edges or face is nearest."""
    n = cross(minus(b, a), minus(c, a))
    inside = [dot(cross(minus(y, x), minus(p, x)), n) >= 0 for x, y in ((a, b), (b, c), (c, a))]
    edges = _least(point_segment_squared(p, a, b), point_segment_squared(p, b, c), point_segment_squared(p, c, a))
    flat = dot(n, n) == 0
    return _when(~flat & inside[0] & inside[1] & inside[2], point_plane_squared(p, a, b, c), edges)


def segment_segment_squared(a, b, c, d) -> Column:
    """Between two segments: the lines' distance where both nearest points are inside, else the least from an end."""
    u, v, w = minus(b, a), minus(d, c), minus(a, c)
    uu, uv, vv, uw, vw = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    det = uu * vv - uv * uv
    s, t = over(uv * vw - vv * uw, det), over(uu * vw - uv * uw, det)
    ends = _least(point_segment_squared(a, c, d), point_segment_squared(b, c, d), point_segment_squared(c, a, b), point_segment_squared(d, a, b))
    between = (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    gap = [w[k] + s * u[k] - t * v[k] for k in range(3)]
    return _when(F.coalesce(between, F.lit(False)) if isinstance(between, Column) else between, dot(gap, gap), ends)


def _bound(values: dict[str, Column], f) -> Column:
    """f of named values, each computed once however often f uses it."""
    if not all(isinstance(v, Column) for v in values.values()):
        return f(values)
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), 1)


def point_point_gradient(a, b) -> Column:
    """Of the squared distance, as an array: by a, then by b."""
    d = minus(a, b)
    return _listed(*scaled(d, 2.0), *scaled(d, -2.0))


def point_line_gradient(p, a, b) -> Column:
    """Of the squared distance to the line through a and b, by p, a and b."""
    ab = minus(b, a)

    def parts(q: Column) -> Column:
        gap = scaled(minus(p, plus(a, scaled(ab, q["t"]))), 2.0)
        return _listed(*gap, *scaled(gap, q["t"] - 1), *scaled(gap, -q["t"]))

    return _bound({"t": over(dot(minus(p, a), ab), dot(ab, ab))}, parts)


def _nearest(u, v, w, other: float) -> Column:
    """(s, t) at which |w - other-signed combination of u and v| is least, with its vector."""
    sums = {"uu": dot(u, u), "uv": dot(u, v), "vv": dot(v, v), "uw": dot(u, w), "vw": dot(v, w)}

    def solved(q: Column) -> Column:
        det = q["uu"] * q["vv"] - q["uv"] * q["uv"]
        s, t = over(q["vv"] * q["uw"] - q["uv"] * q["vw"], det), over(q["uu"] * q["vw"] - q["uv"] * q["uw"], det)
        s = s if other > 0 else -s
        return F.struct(s.alias("s"), t.alias("t")) if isinstance(s, Column) else {"s": s, "t": t}

    return _bound(sums, solved)


def point_plane_gradient(p, a, b, c) -> Column:
    """Of the squared distance to the plane through a, b and c, by p, a, b and c."""
    u, v, w = minus(b, a), minus(c, a), minus(p, a)

    def parts(q: Column) -> Column:
        s, t = q["n"]["s"], q["n"]["t"]
        gap = scaled([w[k] - s * u[k] - t * v[k] for k in range(3)], 2.0)
        return _listed(*gap, *scaled(gap, s + t - 1), *scaled(gap, -s), *scaled(gap, -t))

    return _bound({"n": _nearest(u, v, w, 1.0)}, parts)


def line_line_gradient(a, b, c, d) -> Column:
    """Of the squared distance between the lines a-b and c-d, by their four points."""
    u, v, w = minus(b, a), minus(d, c), minus(a, c)

    def parts(q: Column) -> Column:
        s, t = q["n"]["s"], q["n"]["t"]
        gap = scaled([w[k] + s * u[k] - t * v[k] for k in range(3)], 2.0)
        return _listed(*scaled(gap, 1 - s), *scaled(gap, s), *scaled(gap, t - 1), *scaled(gap, -t))

    return _bound({"n": _nearest(u, v, w, -1.0)}, parts)


def barrier_hessian(d2: Column, reach2: Column, stiffness: Column) -> Column:
    near = (d2 < reach2) & (d2 > 0)
    safe = F.when(near, d2).otherwise(reach2)
    t = safe - reach2
    return F.when(near, stiffness * (-2 * F.log(safe / reach2) - 4 * t / safe + (t / safe) * (t / safe))).otherwise(0.0)


def edges_cross_squared(a, b, c, d) -> Column:
    """Squared length of the cross product of two edges, small where they are nearly parallel."""
    n = cross(minus(b, a), minus(d, c))
    return dot(n, n)


def mollifier_threshold(a, b, c, d) -> Column:
    return 0.01 * point_point_squared(a, b) * point_point_squared(c, d)


def mollifier_slope(x: Column, threshold: Column) -> Column:
    return F.when(x < threshold, 2 * (1 - x / threshold) / threshold).otherwise(0.0)


def mollifier_curve(x: Column, threshold: Column) -> Column:
    return F.when(x < threshold, -2 / (threshold * threshold)).otherwise(0.0)


def friction_f1(x2: Column, eps: Column) -> Column:
    """Slope of the smoothed friction potential over the length of the relative move, of its square."""
    return F.when(x2 >= eps * eps, 1 / F.sqrt(F.when(x2 > 0, x2))).otherwise((2 * eps - F.sqrt(x2)) / (eps * eps))


def friction_f2(eps: Column) -> Column:
    return -1 / (eps * eps)


def tangent_basis(n: list[Column]) -> tuple[list[Column], list[Column]]:
    """Two unit vectors that stand on a unit vector and on each other."""
    flat = F.abs(n[0]) > 0.5
    other = [F.when(flat, -n[1]).otherwise(F.lit(0.0)), F.when(flat, n[0]).otherwise(-n[2]), F.when(flat, F.lit(0.0)).otherwise(n[1])]
    size = F.sqrt(dot(other, other))
    one = [over(x, size) for x in other]
    return one, cross(n, one)


def ray_triangle(origin, direction, a, b, c, eps: float = 2.220446049250313e-15) -> Column:
    """Distance along a ray, in its direction's length, at which it meets a triangle; behind the origin it is
    negative; null where they do not meet."""
    u, v, w = minus(b, a), minus(c, a), minus(origin, a)
    side, turn = cross(direction, v), cross(w, u)
    slope = dot(u, side)
    slope = F.when(F.abs(slope) > eps, slope)
    # Quotients of sums of products: with whole numbers nothing is rounded before the one division, so borders are met exactly.
    first, second = dot(w, side), dot(direction, turn)
    p, q = first / slope, second / slope
    return F.when((p >= -eps) & (q >= -eps) & ((first + second) / slope <= 1 + 2 * eps), dot(v, turn) / slope)


def edge_triangle(p, q, a, b, c) -> Column:
    """Whether a segment meets a triangle that it is not parallel to."""
    t = ray_triangle(p, minus(q, p), a, b, c)
    return F.coalesce((t >= 0) & (t <= 1), F.lit(False))


def box_of(points: list[list[Column]], pad: Column | float = 0.0) -> tuple[list[Column], list[Column]]:
    """Least box around points, (low, high), widened by `pad`."""
    return [F.least(*x) - pad for x in zip(*points, strict=True)], [F.greatest(*x) + pad for x in zip(*points, strict=True)]


def moved(points, velocities, until: Column):
    """Points with the places that they reach."""
    return [*points, *[plus(p, scaled(v, until)) for p, v in zip(points, velocities, strict=True)]]


def ccd_broad_phase(group_a, velocities_a, group_b, velocities_b, distance: Column, until: Column) -> Column:
    """Whether the boxes swept by two groups of points, the first widened, overlap."""
    low_a, high_a = box_of(moved(group_a, velocities_a, until), distance)
    low_b, high_b = box_of(moved(group_b, velocities_b, until))
    return boxes_overlap(low_a, high_a, low_b, high_b)


def torus(point, centre, large: Column, small: Column) -> Column:
    """About the y axis through its centre."""
    d = minus(point, centre)
    across = F.sqrt(d[0] * d[0] + d[2] * d[2]) - large
    return F.sqrt(across * across + d[1] * d[1]) - small


def union(*sdf: Column) -> Column:
    return F.least(*sdf)


def intersection(*sdf: Column) -> Column:
    return F.greatest(*sdf)


def difference(a: Column, b: Column) -> Column:
    return F.greatest(a, -b)


def transition(before: Column, after: Column, ratio: Column) -> Column:
    """A level set on its way from one to another."""
    return before + (after - before) * ratio


def box_normal(point, low, high) -> list[Column]:
    """Outward along the axis of the nearest side, for a point inside."""
    sides = [(p - a, -1.0, k) for k, (p, a) in enumerate(zip(point, low, strict=True))] + [(b - p, 1.0, k) for k, (p, b) in enumerate(zip(point, high, strict=True))]
    nearest = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(k).alias("axis"), F.lit(s).alias("sign")) for d, s, k in sides]))
    return [F.when(nearest["axis"] == k, nearest["sign"]).otherwise(0.0) for k in range(len(point))]


def collide_sticky(velocity, object_velocity, inside: Column) -> list[Column]:
    return [F.when(inside, o).otherwise(v) for v, o in zip(velocity, object_velocity, strict=True)]


def rigid_velocity(point, centre, linear, angular) -> list[Column]:
    """Of a point of a body that moves and turns about its centre."""
    return plus(linear, cross(angular, minus(point, centre)))


def orient_2d(a, b, c) -> Column:
    """Sign of the turn a-b-c in decimals, exact for coordinates of up to four places and nine digits."""
    exact = [[x.cast("decimal(13,4)") for x in p] for p in (a, b, c)]
    det = (exact[1][0] - exact[0][0]) * (exact[2][1] - exact[0][1]) - (exact[1][1] - exact[0][1]) * (exact[2][0] - exact[0][0])
    return F.signum(det).cast("int")


def on_segment_2d(p, a, b) -> Column:
    return (orient_2d(a, b, p) == 0) & (p[0] >= F.least(a[0], b[0])) & (p[0] <= F.greatest(a[0], b[0])) & (p[1] >= F.least(a[1], b[1])) & (p[1] <= F.greatest(a[1], b[1]))


def segments_meet_2d(a, b, c, d) -> Column:
    """Whether two closed segments have a point in common."""
    proper = (orient_2d(a, b, c) * orient_2d(a, b, d) < 0) & (orient_2d(c, d, a) * orient_2d(c, d, b) < 0)
    return proper | on_segment_2d(c, a, b) | on_segment_2d(d, a, b) | on_segment_2d(a, c, d) | on_segment_2d(b, c, d)


def in_triangle_2d(p, a, b, c) -> Column:
    """Inside or on the border, whichever way round the triangle goes; a flat one has its border only."""
    turns = [orient_2d(a, b, p), orient_2d(b, c, p), orient_2d(c, a, p)]
    inside = (F.least(*turns) >= 0) | (F.greatest(*turns) <= 0)
    return F.when(orient_2d(a, b, c) == 0, on_segment_2d(p, a, b) | on_segment_2d(p, b, c) | on_segment_2d(p, c, a)).otherwise(inside)


def degenerate_triangle(a, b, c) -> Column:
    n = cross(minus(b, a), minus(c, a))
    return dot(n, n) == 0


def in_tetrahedron(p, a, b, c, d) -> Column:
    """Inside or on the border: p is on the same side of each face as the fourth corner."""
    side = lambda q, x, y, z: dot(minus(q, x), cross(minus(y, x), minus(z, x)))
    faces = ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))
    out = F.lit(True)
    for x, y, z, other in faces:
        out = out & (side(p, x, y, z) * side(other, x, y, z) >= 0)
    return out
