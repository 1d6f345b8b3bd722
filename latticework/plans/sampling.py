"""Queries: seeded random channels and point samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources import generators as gen
from .registry import Tables, query


def _h(x: str) -> str:
    one = lambda v: f"(xor({v} >> 16, {v}) * 73244475 & 4294967295)"
    return f"(SELECT xor(b >> 16, b) FROM (SELECT {one('a')} AS b FROM (SELECT {one('h')} AS a FROM (SELECT ({x})::HUGEINT & 4294967295 AS h))))"


def _bits(idx: str, seed: int, stream: int = 0) -> str:
    return _h(f"{_h(f'{idx} + {seed * 2654435769 % (1 << 32)}')} + {stream * 40503 + 1}")


def _uniform(idx: str, seed: int, stream: int = 0) -> str:
    return f"({_bits(idx, seed, stream)}::DOUBLE / 4294967296.0)"


def near(c, digits: int = 8):
    return F.round(c, digits) + F.lit(0.0)


@query(f"""SELECT id, round(u0, 8) + 0.0 AS u, floor(u1 * 6)::BIGINT + 1 AS die, round(sqrt(-2 * ln((b3 + 1)::DOUBLE / 4294967297.0)) * cos(u4 * 6.283185307179586), 8) + 0.0 AS n, round(u0 * 4 - 2, 8) + 0.0 AS bx, round(cbrt(u0) * 2 * sqrt(1 - (u1 * 2 - 1) * (u1 * 2 - 1)) * cos(u2 * 6.283185307179586) + 1, 8) + 0.0 AS px, round(cbrt(u0) * 2 * (u1 * 2 - 1), 8) + 0.0 AS pz, round(1 - sqrt(u0), 8) + 0.0 AS w0, round(sqrt(1 - u0) * sin(u1 * 6.283185307179586), 8) + 0.0 AS q0
  FROM (SELECT id, {_uniform('id', 7, 0)} AS u0, {_uniform('id', 7, 1)} AS u1, {_uniform('id', 7, 2)} AS u2, {_bits('id', 7, 3)} AS b3, {_uniform('id', 7, 4)} AS u4 FROM (SELECT p_partkey::BIGINT AS id FROM part))""")
def random_channels(spark, sf_dir):
    i = F.col("id")
    ball = gen.in_ball(i, 7, [1.0, 0.0, 0.0], 2.0)
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id")).select("id", near(gen.uniform(i, 7)).alias("u"), gen.integers(i, 7, 1, 1, 7).alias("die"), near(gen.normal(i, 7, 3)).alias("n"), near(gen.in_box(i, 7, [-2.0], [2.0])[0]).alias("bx"), near(ball[0]).alias("px"), near(ball[2]).alias("pz"), near(gen.barycentric(i, 7)[0]).alias("w0"), near(gen.rotation_quaternion(i, 7)[0]).alias("q0"))


POINTS = "SELECT p_partkey::BIGINT AS id, (p_partkey * 37 % 101) / 4.0::DOUBLE AS x, (p_partkey * 53 % 103) / 4.0::DOUBLE AS y FROM part"


@query(f"WITH p AS (SELECT *, {_bits('id', 3)} AS mark FROM ({POINTS}) WHERE sqrt((x - 12) * (x - 12) + (y - 12) * (y - 12)) - 10 < 0) SELECT id, x, y FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.id <> a.id AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) < 0.75 * 0.75 AND (b.mark < a.mark OR b.mark = a.mark AND b.id < a.id))")
def level_set_samples(spark, sf_dir):
    i = F.col("p_partkey")
    points = Tables(spark, sf_dir).part.select(i.cast("long").alias("id"), (i * 37 % 101 / F.lit(4.0)).alias("x"), (i * 53 % 103 / F.lit(4.0)).alias("y"))
    return gen.sample_level_set(points, g.sphere([F.col("x"), F.col("y")], [F.lit(12.0)] * 2, F.lit(10.0)), 0.75, 3)
