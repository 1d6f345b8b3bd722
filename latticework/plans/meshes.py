"""Queries: meshes of all parts as corners and all lines as elements, written as text, read back, and their normals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import order
from ..operators.lineage import shared_dir
from ..sources import mesh
from .registry import Tables, query

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
PLACE = {"x": "p_size", "y": "p_partkey % 61 - p_retailprice / 64", "z": "p_partkey % 97"}
WHOLE = PLACE | {"y": "p_partkey % 61"}
#: Corners of an element, of {n} parts.
CORNERS = {"a": "l_partkey", "b": "(l_partkey + l_suppkey + 1) % {n}", "c": "(l_partkey * 3 + l_linenumber) % {n}", "d": "(l_suppkey * 7 + l_orderkey) % {n}"}


def _sql(place: dict[str, str], corners: str) -> str:
    named = ", ".join(f"({CORNERS[c].format(n='n')})::BIGINT AS {c}" for c in corners)
    return (
        f"WITH v AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS vid, {', '.join(f'({e})::DOUBLE AS {c}' for c, e in place.items())} FROM part), "
        f"e AS (SELECT row_number() OVER (ORDER BY {', '.join(KEYS)}) - 1 AS eid, {named} FROM lineitem, (SELECT count(*) AS n FROM part))"
    )


def _mesh(spark, sf_dir, place, corners, number=True):
    """Vertices (vid, x, y, z) and elements (eid, *corners), without eid and so without their sort unless `number`."""
    t = Tables(spark, sf_dir)
    parts = t.part.select("p_partkey", "p_size", "p_retailprice")
    n = t.part.count()
    vertices = order.numbered(parts, F.col("p_partkey"), out="vid", rows=n).select("vid", *[F.expr(e).cast("double").alias(c) for c, e in place.items()])
    lines = t.lineitem.select(*KEYS)
    lines = order.numbered(lines, *[F.col(c) for c in KEYS], out="eid", rows=lines.count()) if number else lines
    return vertices, lines.select(*["eid"] * number, *[F.expr(CORNERS[c].format(n=n)).cast("long").alias(c) for c in corners])


def _path(spark) -> str:
    return f"{shared_dir(spark)}/latticework-step-{uuid.uuid4().hex}"


@query(f"{_sql(PLACE, 'abc')} SELECT e.*, v.x, v.y, v.z FROM e JOIN v ON v.vid = e.b")
def obj_mesh(spark, sf_dir):
    """All triangles as they come back from OBJ text, with their second corner's place."""
    path = _path(spark)
    mesh.write_obj(*_mesh(spark, sf_dir, PLACE, "abc"), path)
    vertices, triangles = mesh.read_obj(spark, path)
    return mesh.at_corner(triangles, vertices, "b")


@query(f"{_sql(PLACE, 'abcd')} SELECT e.*, v.x, v.y, v.z FROM e JOIN v ON v.vid = e.d")
def vtk_mesh(spark, sf_dir):
    """All tetrahedra as they come back from an unstructured grid's text, with their last corner's place."""
    path = _path(spark)
    mesh.write_vtk(*_mesh(spark, sf_dir, PLACE, "abcd"), path)
    vertices, tets = mesh.read_vtk(spark, path)
    return mesh.at_corner(tets, vertices, "d")


_U, _W = ({x: f"({c}.{x} - a.{x})" for x in "xyz"} for c in "bc")
_CROSS = ", ".join(f"{_U[p]} * {_W[q]} - {_U[q]} * {_W[p]} AS n{x}" for x, p, q in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")))


@query(
    f"{_sql(WHOLE, 'abc')}, t AS (SELECT e.a, e.b, e.c, {_CROSS} FROM e JOIN v a ON a.vid = e.a JOIN v b ON b.vid = e.b JOIN v c ON c.vid = e.c), "
    "s AS (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT unnest([a, b, c]) AS vid, nx, ny, nz FROM t) GROUP BY vid), l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS size FROM s) "
    "SELECT vid, CASE WHEN size > 0 THEN nx / size ELSE 0.0 END::DOUBLE AS nx, CASE WHEN size > 0 THEN ny / size ELSE 0.0 END::DOUBLE AS ny, CASE WHEN size > 0 THEN nz / size ELSE 0.0 END::DOUBLE AS nz FROM l"
)
def vertex_normals(spark, sf_dir):
    """Unit normals at all parts, from sums over the triangles of all lines; corners are whole numbers, so sums are exact."""
    return mesh.vertex_normals(*_mesh(spark, sf_dir, WHOLE, "abc", number=False))
