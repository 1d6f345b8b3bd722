"""Queries: spatial joins, level sets, contact terms, materials, particle-grid transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import materials
from ..operators import grid, spatial
from .registry import Tables, query

BOX = "SELECT p_partkey::BIGINT AS id, p_size::DOUBLE AS minx, p_size + 0.5 AS maxx, p_retailprice AS miny, p_retailprice + 0.8 AS maxy FROM part"
PART = "SELECT p_partkey::BIGINT AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part"
SUPP = "SELECT s_suppkey::BIGINT AS id, (s_suppkey % 50)::DOUBLE AS x, 900 + abs(s_acctbal) / 12 AS y FROM supplier"


def boxes(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("double").alias("minx"), (F.col("p_size") + 0.5).alias("maxx"), F.col("p_retailprice").alias("miny"), (F.col("p_retailprice") + 0.8).alias("maxy"))


def part_points(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def supplier_points(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    return s.select(F.col("s_suppkey").cast("long").alias("id"), (F.col("s_suppkey") % 50).cast("double").alias("x"), (900 + F.abs("s_acctbal") / 12).alias("y"))


@query(f"WITH b AS ({BOX}), q AS (SELECT id, x - 1 AS minx, x + 1 AS maxx, y - 2 AS miny, y + 2 AS maxy FROM ({SUPP})) SELECT q.id AS id_a, b.id AS id_b FROM q JOIN b ON b.minx <= q.maxx AND b.maxx >= q.minx AND b.miny <= q.maxy AND b.maxy >= q.miny")
def overlap_join(spark, sf_dir):
    q = supplier_points(spark, sf_dir).select("id", (F.col("x") - 1).alias("minx"), (F.col("x") + 1).alias("maxx"), (F.col("y") - 2).alias("miny"), (F.col("y") + 2).alias("maxy"))
    return spatial.box_join(q, boxes(spark, sf_dir), (2.0, 4.0))


@query(f"WITH b AS ({BOX}) SELECT a.id AS id_a, b.id AS id_b FROM b a JOIN b ON a.id < b.id AND b.minx <= a.maxx AND b.maxx >= a.minx AND b.miny <= a.maxy AND b.maxy >= a.miny")
def self_overlap(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return spatial.box_join(b, b, (1.0, 1.0), self_join=True)


@query(f"WITH p AS ({PART}), s AS ({SUPP}) SELECT s.id AS id_a, p.id AS id_b FROM s JOIN p ON s.id <> p.id AND (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) < 9.0")
def radius_join(spark, sf_dir):
    return spatial.radius_join(supplier_points(spark, sf_dir), part_points(spark, sf_dir), 3.0).select("id_a", "id_b")


@query(f"WITH p AS ({PART}), s AS ({SUPP}) SELECT s.id AS id_a, arg_min(p.id, ((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y), p.id)) AS id_b FROM s, p GROUP BY s.id")
def nearest_join(spark, sf_dir):
    return spatial.nearest(supplier_points(spark, sf_dir), part_points(spark, sf_dir), 2.0).select("id_a", F.col("id_b"))


@query(f"WITH b AS ({BOX}) SELECT id, cx::BIGINT AS cx, cy::BIGINT AS cy FROM b, range(0, 60) x(cx), range(400, 1400) y(cy) WHERE cx >= floor(minx / 2) AND cx < ceil(maxx / 2) AND cy >= floor(miny / 2) AND cy < ceil(maxy / 2)")
def spatial_hash_cells(spark, sf_dir):
    return spatial.hash_cells(boxes(spark, sf_dir), 2.0)


@query(f"SELECT floor(x / 4 + 0.5)::BIGINT AS cx, floor(y / 4 + 0.5)::BIGINT AS cy, count(*)::BIGINT AS n, min(id) AS first FROM ({PART}) GROUP BY 1, 2")
def index_buckets(spark, sf_dir):
    return spatial.buckets(part_points(spark, sf_dir), 4.0)


@query("SELECT DISTINCT floor((floor(l_quantity / 2.0 + 0.5) - 2) / 4)::BIGINT AS bx, floor((floor(l_extendedprice / 1000 / 2.0 + 0.5) - 2) / 4)::BIGINT AS by FROM lineitem")
def particle_partition(spark, sf_dir):
    p = Tables(spark, sf_dir).lineitem.select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return spatial.partition(p, 2.0, 4)


@query("WITH b AS (SELECT DISTINCT floor((floor(l_quantity / 2.0 + 0.5) - 2) / 4)::BIGINT AS bx, floor((floor(l_extendedprice / 1000 / 2.0 + 0.5) - 2) / 4)::BIGINT AS by FROM lineitem) SELECT DISTINCT bx + i AS bx, \"by\" + j AS \"by\" FROM b, range(-1, 2) x(i), range(-1, 2) y(j)")
def enlarge_sparsity(spark, sf_dir):
    return spatial.enlarge(particle_partition(spark, sf_dir), -1, 2)


@query("SELECT min(l_quantity) AS min_l_quantity, min(l_extendedprice) AS min_l_extendedprice, max(l_quantity) AS max_l_quantity, max(l_extendedprice) AS max_l_extendedprice FROM lineitem")
def bounding_box(spark, sf_dir):
    return spatial.bounding_box(Tables(spark, sf_dir).lineitem, ["l_quantity", "l_extendedprice"])


XYZ = "SELECT p_partkey::BIGINT AS id, p_size / 10.0::DOUBLE AS x, p_retailprice / 500 AS y, (p_partkey % 17) / 4.0::DOUBLE AS z FROM part"


def space_points(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") / 10.0).alias("x"), (F.col("p_retailprice") / 500).alias("y"), ((F.col("p_partkey") % 17) / 4.0).alias("z"))




def P():  # noqa: N802
    return [F.col("x"), F.col("y"), F.col("z")]


L = lambda *v: [F.lit(float(x)) for x in v]


@query(f"SELECT id, round(sqrt((x-2)*(x-2) + (y-2)*(y-2) + (z-2)*(z-2)) - 1.5, 6) AS sphere, round((x-1)*0.6 + (y-1)*0.8, 6) AS plane, round(sqrt(greatest(dx,0)*greatest(dx,0) + greatest(dy,0)*greatest(dy,0) + greatest(dz,0)*greatest(dz,0)) + least(greatest(dx,dy,dz),0), 6) AS cuboid, round(sqrt(greatest(a,0)*greatest(a,0) + greatest(b,0)*greatest(b,0)) + least(greatest(a,b),0), 6) AS cylinder FROM (SELECT *, greatest(1-x, x-3) AS dx, greatest(1-y, y-3) AS dy, greatest(1-z, z-3) AS dz, sqrt((x-2)*(x-2) + (z-2)*(z-2)) - 1.0 AS a, greatest(-(y-1), y-1-2) AS b FROM ({XYZ}))")
def signed_distances(spark, sf_dir):
    return space_points(spark, sf_dir).select("id", F.round(g.sphere(P(), L(2, 2, 2), F.lit(1.5)), 6).alias("sphere"), F.round(g.plane(P(), L(1, 1, 0), L(0.6, 0.8, 0)), 6).alias("plane"), F.round(g.cuboid(P(), L(1, 1, 1), L(3, 3, 3)), 6).alias("cuboid"), F.round(g.cylinder(P(), L(2, 1, 2), F.lit(1.0), F.lit(2.0)), 6).alias("cylinder"))


@query(f"SELECT id, (x-2)*(x-2) + (y-2)*(y-2) + (z-2)*(z-2) <= 2.25 AS spheres, x <= 3 AND x >= 1 AND y <= 3 AND y >= 1 AND z <= 3 AND z >= 1 AS boxes FROM ({XYZ})")
def overlap_predicates(spark, sf_dir):
    return space_points(spark, sf_dir).select("id", g.spheres_overlap(P(), F.lit(0.5), L(2, 2, 2), F.lit(1.0)).alias("spheres"), g.boxes_overlap(P(), P(), L(1, 1, 1), L(3, 3, 3)).alias("boxes"))


@query(f"SELECT id, greatest(1 - x, 0) <= 3 - x AND y >= 1 AND y <= 3 AND z >= 1 AND z <= 3 AS hit FROM ({XYZ})")
def ray_box(spark, sf_dir):
    return space_points(spark, sf_dir).select("id", g.ray_box(P(), L(1, 0, 0), L(1, 1, 1), L(3, 3, 3)).alias("hit"))


@query(f"SELECT id, round((x-1-2*t)*(x-1-2*t) + (y-1-t)*(y-1-t) + (z-t)*(z-t), 4) AS d2 FROM (SELECT *, least(greatest((2*(x-1) + (y-1) + z) / 6.0, 0), 1) AS t FROM ({XYZ}))")
def point_segment_distance(spark, sf_dir):
    return space_points(spark, sf_dir).select("id", F.round(g.point_segment_squared(P(), L(1, 1, 0), L(3, 2, 1)), 4).alias("d2"))


@query(f"SELECT id, CASE WHEN x > 0 AND x < 2 THEN round(-3 * (x - 2) * (x - 2) * ln(x / 2), 6) ELSE 0 END::DOUBLE AS b, CASE WHEN x > 0 AND x < 2 THEN round(-3 * (2 * (x - 2) * ln(x / 2) + (x - 2) * (x - 2) / x), 6) ELSE 0 END::DOUBLE AS db, round(CASE WHEN x < 3 THEN (2 - x / 3) * x / 3 ELSE 1 END, 6) AS m, round(CASE WHEN x >= 2 THEN x ELSE x * x * (1 - x / 6) / 2 + 2.0 / 3 END, 6) AS f FROM ({XYZ})")
def contact_terms(spark, sf_dir):
    x = F.col("x")
    return space_points(spark, sf_dir).select("id", F.round(g.barrier(x, F.lit(2.0), F.lit(3.0)), 6).alias("b"), F.round(g.barrier_gradient(x, F.lit(2.0), F.lit(3.0)), 6).alias("db"), F.round(g.mollifier(x, F.lit(3.0)), 6).alias("m"), F.round(g.friction_f0(x, F.lit(2.0)), 6).alias("f"))


@query(f"SELECT id, round(CASE WHEN s < 0 THEN x - (0.6*x - 0.8*y)*0.6 ELSE x END, 6) AS slip, round(CASE WHEN s < 0 AND 0.6*x - 0.8*y < 0 THEN x - (0.6*x - 0.8*y)*0.6 ELSE x END, 6) AS apart FROM (SELECT *, sqrt((x-2)*(x-2) + (y-2)*(y-2) + (z-2)*(z-2)) - 1.5 AS s FROM ({XYZ}))")
def collider_response(spark, sf_dir):
    inside = g.sphere(P(), L(2, 2, 2), F.lit(1.5)) < 0
    v, n, o = [F.col("x"), F.col("y"), F.lit(0.0)], L(0.6, -0.8, 0), L(0, 0, 0)
    return space_points(spark, sf_dir).select("id", F.round(g.collide_slip(v, n, o, inside)[0], 6).alias("slip"), F.round(g.collide_separate(v, n, o, inside)[0], 6).alias("apart"))


@query(f"SELECT id, round(m, 4) AS mu, round(l, 4) AS lambda, round(1000 * (pow(1 + y / 10, -7) - 1), 4) AS p, round(m * ((a-1)*(a-1) + (b-1)*(b-1) + (c-1)*(c-1)) + l / 2 * (a*b*c - 1) * (a*b*c - 1), 4) AS corotated, round(m / 2 * (a*a + b*b + c*c - 3) - m * ln(a*b*c) + l / 2 * ln(a*b*c) * ln(a*b*c), 4) AS neo, round(m * (ln(a)*ln(a) + ln(b)*ln(b) + ln(c)*ln(c)) + l / 2 * (ln(a)+ln(b)+ln(c)) * (ln(a)+ln(b)+ln(c)), 4) AS hencky FROM (SELECT id, y, 1 + x / 10 AS a, 1 + y / 10 AS b, 1 + z / 10 AS c, 100 / (2 * 1.3) AS m, 100 * 0.3 / (1.3 * 0.4) AS l FROM ({XYZ}))")
def material_energies(spark, sf_dir):
    mu, lam = materials.lame(F.lit(100.0), F.lit(0.3))
    s = [1 + c / 10 for c in P()]
    r = lambda c: F.round(c, 4)
    return space_points(spark, sf_dir).select("id", r(mu).alias("mu"), r(lam).alias("lambda"), r(materials.pressure(s[1], F.lit(1000.0))).alias("p"), r(materials.fixed_corotated(s, mu, lam)).alias("corotated"), r(materials.neo_hookean(s, mu, lam)).alias("neo"), r(materials.hencky(s, mu, lam)).alias("hencky"))


@query(f"SELECT id, round(CASE WHEN n <= 0.5 THEN 1 ELSE 0.5 / n END, 6) AS k, round(0.4 * 0.1 / sqrt((30 + 4.0 / 3 * 12) / (1 + x)), 6) AS dt FROM (SELECT *, sqrt((x-m)*(x-m) + (y-m)*(y-m) + (z-m)*(z-m)) AS n FROM (SELECT *, (x + y + z) / 3 AS m FROM ({XYZ})))")
def plastic_return_and_step(spark, sf_dir):
    speed = materials.sound_speed(F.lit(30.0), F.lit(12.0), 1 + F.col("x"))
    return space_points(spark, sf_dir).select("id", F.round(materials.von_mises_scale(P(), F.lit(10.0), F.lit(10.0)), 6).alias("k"), F.round(materials.cfl_step(F.lit(0.1), speed, F.lit(0.4)), 6).alias("dt"))


EVENTS = "SELECT event_id::BIGINT AS id, value / 50 AS x, (event_id % 97) / 10.0::DOUBLE AS y, 1.0::DOUBLE AS m, (event_id % 7)::DOUBLE AS vx, (event_id % 5)::DOUBLE AS vy FROM events"
STENCIL = f"SELECT id, x, y, m, vx, vy, (bx + i)::BIGINT AS i, (b_y + j)::BIGINT AS j, CASE i WHEN 0 THEN 0.5*(1.5-fx)*(1.5-fx) WHEN 1 THEN 0.75-(fx-1)*(fx-1) ELSE 0.5*(fx-0.5)*(fx-0.5) END * CASE j WHEN 0 THEN 0.5*(1.5-fy)*(1.5-fy) WHEN 1 THEN 0.75-(fy-1)*(fy-1) ELSE 0.5*(fy-0.5)*(fy-0.5) END AS w FROM (SELECT *, x / 0.5 - bx AS fx, y / 0.5 - b_y AS fy FROM (SELECT *, floor(x / 0.5 - 0.5) AS bx, floor(y / 0.5 - 0.5) AS b_y FROM ({EVENTS}))), range(3) a(i), range(3) b(j)"
GRID = f"SELECT i, j, sum(w * m) AS m, sum(w * m * vx) AS mvx, sum(w * m * vy) AS mvy FROM ({STENCIL}) GROUP BY i, j"


def particles(spark, sf_dir):
    e, i = Tables(spark, sf_dir).events, F.col("event_id")
    return e.select(i.cast("long").alias("id"), (F.col("value") / 50).alias("x"), (i % 97 / 10.0).alias("y"), F.lit(1.0).alias("m"), (i % 7).cast("double").alias("vx"), (i % 5).cast("double").alias("vy"))


@query(f"SELECT i, j, round(m, 6) AS m, round(mvx, 6) AS mvx, round(mvy, 6) AS mvy FROM ({GRID})")
def particles_to_grid(spark, sf_dir):
    return grid.particles_to_grid(particles(spark, sf_dir), 0.5).select("i", "j", *[F.round(c, 6).alias(c) for c in ("m", "mvx", "mvy")])


@query(f"SELECT i, j, round(mvx / m, 5) AS vx, round(mvy / m - 0.981, 5) AS vy FROM ({GRID})")
def grid_velocity(spark, sf_dir):
    v = grid.momentum_to_velocity(grid.particles_to_grid(particles(spark, sf_dir), 0.5), 0.0, -9.81, 0.1)
    return v.select("i", "j", F.round("vx", 5).alias("vx"), F.round("vy", 5).alias("vy"))


@query(f"WITH v AS (SELECT i, j, mvx / m AS gx, mvy / m AS gy FROM ({GRID})) SELECT id, round(first(x) + 0.1 * sum(w * gx), 5) AS x, round(sum(w * gx), 5) AS vx, round(sum(w * gy), 5) AS vy FROM ({STENCIL}) JOIN v USING (i, j) GROUP BY id")
def grid_to_particles(spark, sf_dir):
    p = particles(spark, sf_dir)
    v = grid.momentum_to_velocity(grid.particles_to_grid(p, 0.5))
    return grid.grid_to_particles(p, v, 0.5, 0.1).select("id", *[F.round(c, 5).alias(c) for c in ("x", "vx", "vy")])


_C = ", ".join(f"((event_id + {n}) % 11 - 5) / 10.0::DOUBLE AS c{n}" for n in range(9))
_S = ", ".join(f"((c{n} + c{n % 3 * 3 + n // 3}) * 0.1 - {'10 * (pow(ratio, -7) - 1)' if n % 4 == 0 else '0'}) * 0.1 * ratio * -0.16 AS s{n}" for n in range(9))
_W = " * ".join(f"CASE {n} WHEN 0 THEN 0.5*(1.5-f{a})*(1.5-f{a}) WHEN 1 THEN 0.75-(f{a}-1)*(f{a}-1) ELSE 0.5*(f{a}-0.5)*(f{a}-0.5) END" for a, n in zip("xyz", "ijk", strict=True))
SOLID = f"SELECT event_id::BIGINT AS id, value / 50 AS x, (event_id % 97) / 10.0::DOUBLE AS y, (event_id % 31) / 10.0::DOUBLE AS z, 1.0::DOUBLE AS m, (event_id % 7)::DOUBLE AS vx, (event_id % 5)::DOUBLE AS vy, (event_id % 3)::DOUBLE AS vz, 1 + (event_id % 4) / 20.0::DOUBLE AS ratio, {_C} FROM events"
STENCIL_3D = f"SELECT * EXCLUDE (i, j, k), (bx + i)::BIGINT AS i, (b_y + j)::BIGINT AS j, (bz + k)::BIGINT AS k, (bx + i) * 0.5 - x AS rx, (b_y + j) * 0.5 - y AS ry, (bz + k) * 0.5 - z AS rz, {_W} AS w FROM (SELECT *, x / 0.5 - bx AS fx, y / 0.5 - b_y AS fy, z / 0.5 - bz AS fz, {_S} FROM (SELECT *, floor(x / 0.5 - 0.5) AS bx, floor(y / 0.5 - 0.5) AS b_y, floor(z / 0.5 - 0.5) AS bz FROM ({SOLID}))), range(3) a(i), range(3) b(j), range(3) c(k)"
_MV = ", ".join(f"sum(w * m * (v{a} + c{d} * rx + c{d + 3} * ry + c{d + 6} * rz)) AS mv{a}, sum(w * (s{d} * rx + s{d + 3} * ry + s{d + 6} * rz)) AS f{a}" for d, a in enumerate("xyz"))
GRID_3D = f"SELECT i, j, k, sum(w * m) AS m, {_MV} FROM ({STENCIL_3D}) GROUP BY i, j, k"
NODE = ["m", "mvx", "mvy", "mvz", "fx", "fy", "fz"]


def affine_particles(spark, sf_dir):
    e, i = Tables(spark, sf_dir).events, F.col("event_id")
    c = [((i + n) % 11 - 5) / 10.0 for n in range(9)]
    return e.select(i.cast("long").alias("id"), (F.col("value") / 50).alias("x"), (i % 97 / 10.0).alias("y"), (i % 31 / 10.0).alias("z"), F.lit(1.0).alias("m"), *[(i % n).cast("double").alias(f"v{a}") for a, n in zip("xyz", (7, 5, 3), strict=True)], (1 + i % 4 / 20.0).alias("ratio"), *[v.alias(f"c{n}") for n, v in enumerate(c)])


@query("SELECT i, j, k, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in NODE) + f" FROM ({GRID_3D})")
def affine_particles_to_grid(spark, sf_dir):
    g3 = grid.affine_particles_to_grid(affine_particles(spark, sf_dir), 0.5, 0.01, grid.fluid_stress(0.1, 10.0, 0.1))
    return g3.select("i", "j", "k", *[(F.round(c, 6) + 0.0).alias(c) for c in NODE])


_G = ", ".join(f"sum(w * g{a}) AS u{a}" for a in "xyz") + ", " + ", ".join(f"sum(w * g{'xyz'[n % 3]} * r{'xyz'[n // 3]}) * 16 AS d{n}" for n in range(9))


@query(f"WITH v AS (SELECT i, j, k, (mvx + fx) / m AS gx, (mvy + fy) / m AS gy, (mvz + fz) / m AS gz FROM ({GRID_3D})), g AS (SELECT id, first(x) AS x, first(y) AS y, first(z) AS z, first(ratio) AS ratio, {_G} FROM ({STENCIL_3D}) JOIN v USING (i, j, k) GROUP BY id) SELECT id, " + ", ".join(f"round({a} + 0.01 * u{a}, 5) + 0.0 AS {a}, round(u{a}, 5) + 0.0 AS v{a}" for a in "xyz") + ", " + ", ".join(f"round(d{n}, 5) + 0.0 AS c{n}" for n in range(9)) + ", round((1 + (d0 + d4 + d8) * 0.01) * ratio, 5) + 0.0 AS ratio FROM g")
def affine_grid_to_particles(spark, sf_dir):
    p = affine_particles(spark, sf_dir)
    g3 = grid.affine_velocity(grid.affine_particles_to_grid(p, 0.5, 0.01, grid.fluid_stress(0.1, 10.0, 0.1)))
    out = grid.affine_grid_to_particles(p, g3, 0.5, 0.01)
    return out.select("id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("x", "vx", "y", "vy", "z", "vz", *[f"c{n}" for n in range(9)], "ratio")])


@query(f"SELECT round(sum(mvx), 3) AS px, round(sum(mvy), 3) AS py, round(sum(i * mvy - j * mvx), 2) AS l FROM ({GRID})")
def grid_angular_momentum(spark, sf_dir):
    return grid.angular_momentum(grid.particles_to_grid(particles(spark, sf_dir), 0.5)).select(F.round("px", 3).alias("px"), F.round("py", 3).alias("py"), F.round("l", 2).alias("l"))


@query(f"SELECT id, round(sum(w * coalesce(gm, 7.0)), 5) AS m FROM ({STENCIL}) LEFT JOIN (SELECT i, j, CASE WHEN (i + j) % 2 = 0 THEN m END AS gm FROM ({GRID})) USING (i, j) GROUP BY id")
def sample_with_background(spark, sf_dir):
    p = particles(spark, sf_dir)
    half = grid.particles_to_grid(p, 0.5).where((F.col("i") + F.col("j")) % 2 == 0)
    return grid.sample(half, p, 0.5, "m", 7.0).select("id", F.round("m", 5).alias("m"))


@query("WITH RECURSIVE c AS (SELECT DISTINCT (event_id % 40)::BIGINT AS i, (event_id // 40 % 40)::BIGINT AS j FROM events WHERE (event_id * 7919) % 10 < 8), f AS (SELECT i, j FROM c WHERE i = 0 UNION SELECT c.i, c.j FROM f JOIN c ON abs(c.i - f.i) + abs(c.j - f.j) = 1) SELECT i, j FROM f")
def flood_fill(spark, sf_dir):
    i = F.col("event_id").cast("long")
    cells = Tables(spark, sf_dir).events.where((i * 7919) % 10 < 8).select((i % 40).alias("i"), (F.floor(i / 40) % 40).cast("long").alias("j")).distinct()
    return grid.flood_fill(cells.where("i = 0"), cells)


@query(f"SELECT i, j, round(m, 6) AS m, 0.0::DOUBLE AS mvx, 0.0::DOUBLE AS mvy, 1 AS mark FROM ({GRID}) WHERE (i + 2 * j) % 3 = 0")
def grid_clean_and_refit(spark, sf_dir):
    """Nodes without momentum, of which those that are marked stay."""
    cleaned = grid.clean(grid.particles_to_grid(particles(spark, sf_dir), 0.5), "mvx", "mvy")
    return grid.refit(grid.mark(cleaned, (F.col("i") + 2 * F.col("j")) % 3 == 0)).withColumn("m", F.round("m", 6))
