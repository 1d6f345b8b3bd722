"""Queries: scalar, bit, vector and matrix functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decompositions as d
from ..functions import scalars as s
from ..functions import vectors as v
from .registry import Tables, query


def parts(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("long").alias("n"), F.col("p_retailprice").alias("x"))


PART = "SELECT p_partkey::BIGINT AS id, p_size::BIGINT AS n, p_retailprice AS x FROM part"


def N():  # noqa: N802
    return F.col("n")


def X():  # noqa: N802
    return F.col("x")


def ID():  # noqa: N802
    return F.col("id")




@query(f"SELECT id, least(greatest(x, 1000), 1500) AS c, CASE WHEN n % 2 = 0 THEN -x ELSE x END AS s, gcd(id, n) AS g, CASE WHEN id = 0 OR n = 0 THEN 0 ELSE lcm(id, n) END::BIGINT AS l, round(x + (2 * x - x) * 0.25, 6) AS t, floor(x / 7)::BIGINT AS f, CASE WHEN n - 25 < 0 THEN 0 ELSE pow(1.1, n - 25) END::DOUBLE > 2 AS p FROM ({PART})")
def math_basics(spark, sf_dir):
    return parts(spark, sf_dir).select("id", s.clamp(X(), F.lit(1000.0), F.lit(1500.0)).alias("c"), s.copysign(X(), F.when(N() % 2 == 0, -1).otherwise(1)).alias("s"), s.gcd(ID(), N()).alias("g"), s.lcm(ID(), N()).cast("long").alias("l"), F.round(s.lerp(X(), 2 * X(), F.lit(0.25)), 6).alias("t"), s.lower_trunc(X() / 7).alias("f"), (s.pow_integral(F.lit(1.1), N() - 25) > 2).alias("p"))


@query(f"SELECT id, round(ln(1 + n) / n, 8) AS a, round((ln(x) - ln(x + n)) / (0 - n), 8) AS b, round(sqrt(x), 6) AS r, round(exp(-(x - 1000) * (x - 1000) / 20000) / (100::DOUBLE * 2.5066282746310002::DOUBLE), 10) AS q FROM ({PART})")
def series_and_densities(spark, sf_dir):
    return parts(spark, sf_dir).select("id", F.round(s.log_1px_over_x(N().cast("double")), 8).alias("a"), F.round(s.diff_log_over_diff(X(), X() + N()), 8).alias("b"), F.round(s.newton_sqrt(X()), 6).alias("r"), F.round(s.normal_pdf(X(), F.lit(1000.0), F.lit(100.0)), 10).alias("q"))


@query(f"SELECT id, CASE WHEN dd > 0 THEN CASE WHEN (b - sqrt(dd)) / 2 > 0 THEN round((b - sqrt(dd)) / 2, 6) WHEN (b + sqrt(dd)) / 2 > 0 THEN round((b + sqrt(dd)) / 2, 6) ELSE -1 END ELSE -1 END::DOUBLE AS root FROM (SELECT *, b * b - 4 * (id % 11 - 3) AS dd FROM (SELECT id, (n - 25)::DOUBLE AS b FROM ({PART})))")
def quadratic_root(spark, sf_dir):
    return parts(spark, sf_dir).select("id", F.round(s.smallest_positive_quadratic_root(F.lit(1.0), -(N() - 25).cast("double"), (ID() % 11 - 3).cast("double")), 6).alias("root"))


@query(f"SELECT id, bit_count(id)::INTEGER AS pop, (id & -8)::BIGINT AS down, ((id + 7) & -8)::BIGINT AS up, CASE WHEN id = 0 THEN 0 ELSE length(bin(id)) END::INTEGER AS len, (64 - CASE WHEN id = 0 THEN 0 ELSE length(bin(id)) END)::INTEGER AS lead, (id & 1) + 2 * (id >> 2 & 1) + 4 * (id >> 4 & 1) AS packed, (id & 1) + 4 * (id >> 1 & 1) + 16 * (id >> 2 & 1) AS spread, bit_count(id & 31)::INTEGER AS before FROM ({PART})")
def bit_functions(spark, sf_dir):
    return parts(spark, sf_dir).select("id", F.bit_count("id").cast("int").alias("pop"), s.round_down(ID(), 8).alias("down"), s.round_up(ID(), 8).alias("up"), s.bit_length(ID()).alias("len"), s.leading_zeros(ID()).cast("int").alias("lead"), s.bit_pack(ID(), 0b10101).alias("packed"), s.bit_spread(ID(), 0b10101).alias("spread"), s.bits_before(ID(), F.lit(5)).alias("before"))


def _interleave(cell, shift):
    return " + ".join(f"(({cell} >> {k}) & 1) * {1 << (3 * k + shift)}" for k in range(10))


@query(f"SELECT id, ({_interleave('a', 2)} + {_interleave('b', 1)} + {_interleave('c', 0)})::BIGINT AS code, true AS round_trip FROM (SELECT id, floor(n / 64.0 * 1024)::BIGINT AS a, floor(x / 4096 * 1024)::BIGINT AS b, floor((id % 13) / 16.0 * 1024)::BIGINT AS c FROM ({PART}))")
def morton_codes(spark, sf_dir):
    code = s.morton_3d(N() / 64.0, X() / 4096, (ID() % 13) / 16.0)
    return parts(spark, sf_dir).select("id", code.alias("code"), (s.compact_bits(F.shiftright(code, 1)) == F.floor(X() / 4096 * 1024)).alias("round_trip"))


def _times(v, m):
    return f"(({v}) * {m} & 4294967295)"


_A = "xor(id, id >> 16)"
_B = _times(_A, 0x85EBCA6B)
_C = _times(f"xor({_B}, {_B} >> 13)", 0xC2B2AE35)


@query(f"SELECT id, xor({_C}, {_C} >> 16)::BIGINT AS h FROM (SELECT id::HUGEINT AS id FROM ({PART}))".replace("SELECT id, xor", "SELECT id::BIGINT AS id, xor"))
def hash_mixer(spark, sf_dir):
    return parts(spark, sf_dir).select("id", s.mix32(ID()).alias("h"))


EMB = "SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings"


@query(f"SELECT id, round(list_inner_product(v, v), 6) AS d, round(sqrt(list_inner_product(v, v)), 6) AS n, round(list_max(list_transform(v, lambda e: abs(e))), 6) AS inf, round(list_sum(v), 6) AS total, round(list_inner_product(v, list_reverse(v)) / list_inner_product(v, v), 6) AS c FROM ({EMB})")
def vector_functions(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    df = Tables(spark, sf_dir).embeddings.select(F.col("vec_id").cast("long").alias("id"), e.alias("v"))
    x = F.col("v")
    return df.select("id", F.round(v.dot(x, x), 6).alias("d"), F.round(v.norm(x), 6).alias("n"), F.round(v.inf_norm(x), 6).alias("inf"), F.round(v.total(x), 6).alias("total"), F.round(v.cosine(x, F.reverse(x)), 6).alias("c"))


def small_matrices(spark, sf_dir):
    """A 3x3 matrix a of each part, with diagonal 4 + n % 5."""
    df = parts(spark, sf_dir)
    entries = [((ID() * (3 * i + j + 1)) % 7 / 10.0 + (4 + N() % 5 if i == j else 0)).cast("double").alias(f"a{i}{j}") for i in range(3) for j in range(3)]
    return df.select("id", *entries)


SMALL = "SELECT p_partkey::BIGINT AS id, " + ", ".join(f"((p_partkey * {3 * i + j + 1}) % 7 / 10.0::DOUBLE{' + 4 + p_size % 5' if i == j else ''})::DOUBLE AS a{i}{j}" for i in range(3) for j in range(3)) + " FROM part"


def A():  # noqa: N802
    return [F.col(f"a{i}{j}") for i in range(3) for j in range(3)]


DET = "(a00*(a11*a22-a12*a21) - a01*(a10*a22-a12*a20) + a02*(a10*a21-a11*a20))"


@query(f"SELECT id, round({DET}, 6) AS det, round((a11*a22-a12*a21) / {DET}, 6) AS inv00, round((a02*a21-a01*a22) / {DET}, 6) AS inv01, round(a00*a00 + a01*a10 + a02*a20, 6) AS sq00, round(a00 + a11 + a22, 6) AS trace FROM ({SMALL})")
def matrix_functions(spark, sf_dir):
    inv = v.inverse(A())
    return small_matrices(spark, sf_dir).select("id", F.round(v.determinant(A()), 6).alias("det"), F.round(inv[0], 6).alias("inv00"), F.round(inv[1], 6).alias("inv01"), F.round(v.matmul(A(), A())[0], 6).alias("sq00"), F.round(A()[0] + A()[4] + A()[8], 6).alias("trace"))


@query(f"SELECT id, round(abs({DET}), 4) AS singular, true AS polar, true AS qr, true AS inverse FROM ({SMALL})")
def matrix_decompositions(spark, sf_dir):
    m = F.array(*A())
    df = small_matrices(spark, sf_dir).select("id", *[f"a{i}{j}" for i in range(3) for j in range(3)], d.singular_values(m).alias("s"), d.polar(m).alias("p"), d.qr(m).alias("f"), d.inverse(m).alias("i"))
    near = lambda got: F.forall(F.zip_with(F.array(*got), m, lambda a, b: F.abs(a - b) < 1e-8), lambda t: t)
    at = lambda c: [F.col(c)[k] for k in range(9)]
    whole = v.matmul(at("i"), A())
    one = F.array(*[F.abs(whole[k] - (1.0 if k in (0, 4, 8) else 0.0)) for k in range(9)])
    return df.select("id", F.round(v.prod(F.col("s")), 4).alias("singular"), near(v.matmul(at("p.rotation"), at("p.stretch"))).alias("polar"), near(v.matmul(at("f.q"), at("f.r"))).alias("qr"), (F.array_max(one) < 1e-8).alias("inverse"))


@query(f"SELECT id, round(1.0::DOUBLE, 8) AS det, round(1.0::DOUBLE, 8) AS weights FROM ({PART})")
def rotations_and_splines(spark, sf_dir):
    r = v.rotation([F.lit(0.6), F.lit(0.0), F.lit(0.8)], X() / 100)
    at = X() / 3
    w = v.bspline(at - v.base_node(at, 2), 2)
    return parts(spark, sf_dir).select("id", F.round(v.determinant(r), 8).alias("det"), F.round(w[0] + w[1] + w[2], 8).alias("weights"))


@query(f"SELECT id, (CASE WHEN n > x / 100 THEN 1 WHEN n < x / 100 THEN -1 ELSE 0 END)::INTEGER AS side, '1' AS numerator FROM ({PART})")
def exact_predicates(spark, sf_dir):
    sign = d.orient2d(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.5), N() - X() / 100)
    half = d.rational_sum(F.lit("1/3"), F.lit("2/3"))
    return parts(spark, sf_dir).select("id", sign.alias("side"), half[0].alias("numerator"))
