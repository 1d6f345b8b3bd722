"""Queries: scalar, complex, bit, small-vector and small-matrix functions, entry by entry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matrices as m
from ..functions import scalars as s
from ..functions import vectors as v
from .functions import PART, parts
from .registry import Tables, query


def N():  # noqa: N802
    return F.col("n")


def X():  # noqa: N802
    return F.col("x")


def ID():  # noqa: N802
    return F.col("id")


def near(c, digits: int = 8):
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def rounded(sql: str, digits: int = 8) -> str:
    return f"round({sql}, {digits}) + 0.0"


@query(f"SELECT id, x * n + 1.5 AS fma, (n - 25) % 7 AS rest, (n - 25)::DOUBLE % 3.5 AS rest2, trunc((n - 25) * 0.3) + 0.0 AS whole, {rounded('(n - 25) * 0.3 - trunc((n - 25) * 0.3)')} AS part, x * x AS square, {rounded('1 / sqrt(x)', 12)} AS inverse_root, x * pow(2, n % 5 - 2) AS scaled FROM ({PART})")
def float_parts(spark, sf_dir):
    whole, part = s.modf((N() - 25) * F.lit(0.3))
    return parts(spark, sf_dir).select("id", s.fma(X(), N(), F.lit(1.5)).alias("fma"), s.fmod(N() - 25, F.lit(7)).cast("long").alias("rest"), s.fmod((N() - 25).cast("double"), F.lit(3.5)).alias("rest2"), (whole + 0.0).alias("whole"), near(part).alias("part"), s.sqr(X()).alias("square"), near(s.rsqrt(X()), 12).alias("inverse_root"), s.ldexp(X(), N() % 5 - 2).alias("scaled"))


@query(f"SELECT id, CASE WHEN id = 0 THEN 0 ELSE id / pow(2, length(bin(id))) END::DOUBLE AS mantissa, CASE WHEN id = 0 THEN 0 ELSE length(bin(id)) END::INTEGER AS exponent FROM ({PART})")
def mantissa_and_exponent(spark, sf_dir):
    mantissa, exponent = s.frexp(ID().cast("double"))
    return parts(spark, sf_dir).select("id", mantissa.alias("mantissa"), exponent.alias("exponent"))


T = "(n - 25) / 20.0::DOUBLE"


@query(f"SELECT id, {rounded('ln(x)')} AS ln, {rounded(f'ln(1 + n / 50.0::DOUBLE)')} AS ln1, {rounded(f'exp({T})')} AS e, {rounded(f'pow(x, {T})', 4)} AS p, {rounded(f'sin({T})')} AS s, {rounded(f'cos({T})')} AS c, {rounded(f'(exp({T}) - exp(-({T}))) / 2')} AS sh, {rounded(f'(exp({T}) + exp(-({T}))) / 2')} AS ch, {rounded(f'asin(n / 50.0::DOUBLE)')} AS arcs, {rounded(f'acos(n / 50.0::DOUBLE)')} AS arcc, {rounded(f'ln({T} + sqrt(({T}) * ({T}) + 1))')} AS arsh, {rounded('ln(x + sqrt(x * x - 1))')} AS arch, {rounded(f'atan2({T}, x / 1000)')} AS a2 FROM ({PART})")
def transcendental(spark, sf_dir):
    t = (N() - 25) / F.lit(20.0)
    u = N() / F.lit(50.0)
    return parts(spark, sf_dir).select("id", near(F.log(X())).alias("ln"), near(F.log1p(u)).alias("ln1"), near(F.exp(t)).alias("e"), near(F.pow(X(), t), 4).alias("p"), near(F.sin(t)).alias("s"), near(F.cos(t)).alias("c"), near(F.sinh(t)).alias("sh"), near(F.cosh(t)).alias("ch"), near(F.asin(u)).alias("arcs"), near(F.acos(u)).alias("arcc"), near(F.asinh(t)).alias("arsh"), near(F.acosh(X())).alias("arch"), near(F.atan2(t, X() / 1000)).alias("a2"))


@query(f"SELECT id, {rounded('ln(x + n) - (x + n) * (ln(x) - ln(x + n)) / (0 - n)')} AS interlock, round(exp(n % 9 * ln(3.5) - 3.5) / CAST(factorial((n % 9)::INTEGER) AS DOUBLE), 10) AS poisson, abs((n - 25) * 1e-14::DOUBLE) <= 128 * 2.220446049250313e-16::DOUBLE AS zero FROM ({PART})")
def densities_and_logs(spark, sf_dir):
    return parts(spark, sf_dir).select("id", near(s.diff_interlock_log_over_diff(X(), X() + N(), F.log(X() + N()))).alias("interlock"), F.round(s.poisson_pdf(N() % 9, F.lit(3.5)), 10).alias("poisson"), s.near_zero((N() - 25) * F.lit(1e-14)).alias("zero"))


@query(f"SELECT id, round(least(CASE WHEN n % 10 > 4.5 THEN n % 10 - 4.5 ELSE 1e9 END, CASE WHEN id % 7 > 3.5 THEN id % 7 - 3.5 ELSE 1e9 END, id % 5 + 1)::DOUBLE, 4) AS root FROM ({PART})")
def cubic_root(spark, sf_dir):
    """Of 2 (x - p)(x - q)(x - r), of which r is positive."""
    p, q, r = N() % 10 - F.lit(4.5), ID() % 7 - F.lit(3.5), ID() % 5 + F.lit(1.0)
    root = s.smallest_positive_cubic_root(F.lit(2.0), -2.0 * (p + q + r), 2.0 * (p * q + q * r + p * r), -2.0 * p * q * r)
    return parts(spark, sf_dir).select("id", F.round(root, 4).alias("root"))


@query(f"SELECT id, (id << 1 & -8 | 4)::BIGINT AS setting, (id & -5)::BIGINT AS cleared, xor(id, 4)::BIGINT AS toggled, (id & ~n)::BIGINT AS less, CASE WHEN n = 0 THEN 0 ELSE length(bin((n & -n))) END::INTEGER AS first, round((((id * 1000003) & 4294967295) >> 9) / 8388608.0, 9) AS unit, xor(id, (n + 2654435769 + (id << 6) + (id >> 2)) & 4294967295)::BIGINT AS combined, true AS back FROM ({PART})")
def masks_and_hashes(spark, sf_dir):
    bits = (ID() * 1000003).bitwiseAND(0xFFFFFFFF)
    shifted = F.shiftleft(ID(), 1).bitwiseAND(-8)
    return parts(spark, sf_dir).select("id", s.set_bit(shifted, 2).alias("setting"), s.set_bit(ID(), 2, on=False).alias("cleared"), s.toggle_bit(ID(), 2).alias("toggled"), s.mask_minus(ID(), N()).alias("less"), s.find_first_set(N()).alias("first"), F.round(s.unit_float(bits), 9).alias("unit"), s.hash_combine(ID(), N()).alias("combined"), (s.unhash32(s.hash32(ID() * 77777)) == (ID() * 77777).bitwiseAND(0xFFFFFFFF)).alias("back"))


_H = "(xor({x} >> 16, {x}) * 73244475 & 4294967295)"


def _hash(x: str) -> str:
    one = _H.format(x=x)
    return f"(SELECT xor(b >> 16, b) FROM (SELECT {_H.format(x='a')} AS b FROM (SELECT {one} AS a)))"


@query(f"SELECT id, {_hash('h')}::BIGINT AS h FROM (SELECT id, id::HUGEINT * 77777 & 4294967295 AS h FROM ({PART}))")
def reversible_hash(spark, sf_dir):
    return parts(spark, sf_dir).select("id", s.hash32(ID() * 77777).alias("h"))


RE, IM = "((n - 25) / 10.0::DOUBLE)", "(x / 1000.0::DOUBLE)"


@query(f"""SELECT id, {rounded('sqrt(r*r + i*i)')} AS size, {rounded('atan2(i, r)')} AS angle, {rounded('r*r + i*i')} AS norm, {rounded('-i')} AS conj_im, {rounded('exp(r) * cos(i)')} AS exp_re, {rounded('exp(r) * sin(i)')} AS exp_im,
  {rounded('ln(sqrt(r*r + i*i))')} AS log_re, {rounded('atan2(i, r) / ln(10)')} AS log10_im, {rounded('sin(r) * (exp(i) + exp(-i)) / 2')} AS sin_re, {rounded('-sin(r) * (exp(i) - exp(-i)) / 2')} AS cos_im, {rounded('(exp(r) - exp(-r)) / 2 * cos(i)')} AS sinh_re, {rounded('(exp(r) - exp(-r)) / 2 * sin(i)')} AS cosh_im,
  {rounded('sin(2*r) / (cos(2*r) + (exp(2*i) + exp(-2*i)) / 2)', 6)} AS tan_re, {rounded('((exp(2*r) - exp(-2*r)) / 2) / ((exp(2*r) + exp(-2*r)) / 2 + cos(2*i))', 6)} AS tanh_re, {rounded('r', 6)} AS sqrt_back, {rounded('i', 6)} AS sin_back, {rounded('r', 6)} AS tanh_back, {rounded('r', 6)} AS cos_back, {rounded('i', 6)} AS tan_back, {rounded('r', 6)} AS cosh_back, {rounded('r*r - i*i + 1e-7', 4)} AS square_re, {rounded('2*r*i + 1e-7', 4)} AS square_im, {rounded('(r*2 + i*3) / 13')} AS ratio
  FROM (SELECT id, {RE} AS r, {IM} AS i FROM ({PART}))""")
def complex_functions(spark, sf_dir):
    """Values by their formulas; inverse functions by what leads back to the number (sqrt(z)^2, sin(asin z), tanh(atanh z))."""
    z = s.complex_number((N() - 25) / F.lit(10.0), X() / F.lit(1000.0))
    part = lambda c, k, d=8: near(c[k], d)
    root, power = s.complex_sqrt(z), s.complex_pow(z, s.complex_number(F.lit(2.0), F.lit(0.0)))
    return parts(spark, sf_dir).select(
        "id", near(s.complex_abs(z)).alias("size"), near(s.complex_arg(z)).alias("angle"), near(s.complex_norm(z)).alias("norm"), part(s.complex_conj(z), "im").alias("conj_im"), part(s.complex_exp(z["re"], z["im"]), "re").alias("exp_re"), part(s.complex_exp(z["re"], z["im"]), "im").alias("exp_im"),
        part(s.complex_log(z), "re").alias("log_re"), part(s.complex_log10(z), "im").alias("log10_im"), part(s.complex_sin(z), "re").alias("sin_re"), part(s.complex_cos(z), "im").alias("cos_im"), part(s.complex_sinh(z), "re").alias("sinh_re"), part(s.complex_cosh(z), "im").alias("cosh_im"),
        part(s.complex_tan(z), "re", 6).alias("tan_re"), part(s.complex_tanh(z), "re", 6).alias("tanh_re"), part(s.complex_multiply(root["re"], root["im"], root["re"], root["im"]), "re", 6).alias("sqrt_back"), part(s.complex_sin(s.complex_asin(z)), "im", 6).alias("sin_back"), part(s.complex_tanh(s.complex_atanh(z)), "re", 6).alias("tanh_back"), part(s.complex_cos(s.complex_acos(z)), "re", 6).alias("cos_back"), part(s.complex_tan(s.complex_atan(z)), "im", 6).alias("tan_back"), part(s.complex_cosh(s.complex_acosh(z)), "re", 6).alias("cosh_back"), near(power["re"] + 1e-7, 4).alias("square_re"), near(power["im"] + 1e-7, 4).alias("square_im"),
        part(s.complex_divide(z, s.complex_number(F.lit(2.0), F.lit(3.0))), "re").alias("ratio"),
    )


VEC = "SELECT p_partkey::BIGINT AS id, (p_size - 25)::DOUBLE AS a, p_retailprice / 500 AS b, (p_partkey % 13)::DOUBLE AS c FROM part"


def small_vectors(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") - 25).cast("double").alias("a"), (F.col("p_retailprice") / 500).alias("b"), (F.col("p_partkey") % 13).cast("double").alias("c"))


@query(f"""SELECT id, a * b * c AS prod, {rounded('a + b + c')} AS total, {rounded('a*a + b*b + c*c')} AS square, greatest(abs(a), b, c) AS inf, greatest(a, b, c) AS high, least(a, b, c) AS low, {rounded('b / sqrt(a*a + b*b + c*c)')} AS unit1, {rounded('a - (a + b + c) / 3')} AS dev0, {rounded('exp(c)', 4)} AS exp2, {rounded('sqrt(b)')} AS root1, {rounded('b*b*b')} AS cube1, {rounded('1 / b')} AS inverse1,
  {rounded('b*a - c*b')} AS cross0, {rounded('c*c - a*a')} AS cross1, {rounded('a*b - b*c')} AS cross2, {rounded('a*c + b*b + c*a')} AS dots, {rounded('0.0*a + 0.0')} AS parallel_size, (a::BIGINT & 7)::BIGINT AS masked, (c::BIGINT << 3)::BIGINT AS shifted FROM ({VEC})""")
def small_vector_functions(spark, sf_dir):
    x, y = F.array("a", "b", "c"), F.array("c", "b", "a")
    a, b = [F.col(k) for k in "abc"], [F.col(k) for k in "cba"]
    cross = v.cross(a, b)
    double = v.cross(a, [2 * k for k in a])
    return small_vectors(spark, sf_dir).select(
        "id", v.prod(x).alias("prod"), near(v.total(x)).alias("total"), near(v.dot(x, x)).alias("square"), v.inf_norm(x).alias("inf"), F.array_max(x).alias("high"), F.array_min(x).alias("low"), near(v.normalized(x)[1]).alias("unit1"), near(v.deviatoric(x)[0]).alias("dev0"), near(v.mapped(x, F.exp)[2], 4).alias("exp2"), near(v.mapped(x, F.sqrt)[1]).alias("root1"), near(v.mapped(x, lambda k: k * k * k)[1]).alias("cube1"), near(v.mapped(x, lambda k: 1 / F.when(k != 0, k))[1]).alias("inverse1"),
        *[near(c).alias(f"cross{k}") for k, c in enumerate(cross)], near(v.dot(x, y)).alias("dots"), near(F.sqrt(v.dot(F.array(*double), F.array(*double)))).alias("parallel_size"), F.col("a").cast("long").bitwiseAND(7).alias("masked"), F.shiftleft(F.col("c").cast("long"), 3).alias("shifted"),
    )


MAT = {n: [f"(({'p_partkey' if (i + j) % 2 else 'p_size'} * {3 * i + 2 * j + 1}) % 7 / 5.0::DOUBLE{' + 3' if i == j else ''})" for i in range(n) for j in range(n)] for n in (1, 2, 3, 4)}


def matrix_columns(n: int) -> list:
    out = []
    for i in range(n):
        for j in range(n):
            base = F.col("p_partkey") if (i + j) % 2 else F.col("p_size")
            out.append((base * (3 * i + 2 * j + 1)) % 7 / F.lit(5.0) + (3 if i == j else 0))
    return out


def _det(e: list[str], n: int) -> str:
    if n == 1:
        return e[0]
    return "(" + " + ".join(f"{'-' if j % 2 else ''}({e[j]}) * {_det([e[i * n + k] for i in range(1, n) for k in range(n) if k != j], n - 1)}" for j in range(n)) + ")"


def _minor(e: list[str], n: int, r: int, c: int) -> str:
    return _det([e[i * n + k] for i in range(n) if i != r for k in range(n) if k != c], n - 1) if n > 1 else "1.0"


def _matrix_sql(n: int) -> str:
    e = [f"m{k}" for k in range(n * n)]
    inner = ", ".join(f"{x} AS m{k}" for k, x in enumerate(MAT[n]))
    entries = ", ".join(f"{rounded(f'{"-" if (r + c) % 2 else ""}{_minor(e, n, c, r)} / d', 6)} AS i{r}{c}" for r in range(n) for c in range(n))
    cofactors = ", ".join(f"{rounded(f'{"-" if (r + c) % 2 else ""}{_minor(e, n, r, c)}', 6)} AS c{r}{c}" for r in range(n) for c in range(n))
    return f"SELECT id, {rounded('d', 6)} AS det, {cofactors}, {entries} FROM (SELECT *, {_det(e, n)} AS d FROM (SELECT p_partkey::BIGINT AS id, {inner} FROM part))"


def _matrix_query(n: int):
    def run(spark, sf_dir):
        a = [F.col(f"m{k}") for k in range(n * n)]
        df = Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), *[c.alias(f"m{k}") for k, c in enumerate(matrix_columns(n))])
        inverse, cofactor = m.inverse(a, n), m.cofactors(a, n)
        return df.select("id", near(m.determinant(a, n), 6).alias("det"), *[near(cofactor[r * n + c], 6).alias(f"c{r}{c}") for r in range(n) for c in range(n)], *[near(inverse[r * n + c], 6).alias(f"i{r}{c}") for r in range(n) for c in range(n)])

    run.__name__ = f"inverse_{n}x{n}"
    return query(_matrix_sql(n))(run)


for _n in (1, 2, 3, 4):
    _matrix_query(_n)


def _entries(name: str, f, n: int = 3) -> str:
    return ", ".join(f"{rounded(f(i, j), 6)} AS {name}{i}{j}" for i in range(n) for j in range(n))


M3 = ", ".join(f"{x} AS m{k}" for k, x in enumerate(MAT[3]))


@query(f"SELECT id, {_entries('p', lambda i, j: ' + '.join(f'm{3 * i + k} * m{3 * j + k}' for k in range(3)))}, {rounded('m0 * 1.0 + m1 * 2 + m2 * 3', 6)} AS y0, {rounded('m0 * 1.0 + m3 * 2 + m6 * 3', 6)} AS z0, {rounded('m0 + m4 + m8', 6)} AS trace, {rounded('m1 * 2', 6)} AS diag01, {rounded('m5 * 3', 6)} AS dyad12, {rounded('-m2', 6)} AS cross01 FROM (SELECT p_partkey::BIGINT AS id, {M3} FROM part)")
def matrix_products(spark, sf_dir):
    """A A^T entry by entry, A x, x A, trace, rows scaled, a dyadic product and a cross matrix."""
    a, x = [F.col(f"m{k}") for k in range(9)], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    df = Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), *[c.alias(f"m{k}") for k, c in enumerate(matrix_columns(3))])
    p = v.matmul(a, m.transpose(a, 3))
    return df.select("id", *[near(p[3 * i + j], 6).alias(f"p{i}{j}") for i in range(3) for j in range(3)], near(m.times_vector(a, x)[0], 6).alias("y0"), near(m.vector_times(x, a)[0], 6).alias("z0"), near(m.trace(a, 3), 6).alias("trace"), near(m.columns_scaled(a, x)[1], 6).alias("diag01"), near(m.dyadic(m.row(a, 1, 3), x)[5 + 3], 6).alias("dyad12"), near(m.cross_matrix(m.row(a, 0, 3))[1], 6).alias("cross01"))


SYM = "SELECT p_partkey::BIGINT AS id, 2 + p_size % 5 + 0.0::DOUBLE AS a, (p_partkey % 7 - 3)::DOUBLE AS b, -1 + p_size % 3 + 0.0::DOUBLE AS c FROM part"


@query(f"SELECT id, {rounded('(a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)')} AS high, {rounded('(a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b)')} AS low, {rounded('a + greatest(0, -((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b))) + greatest(0, -((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b))) - a - c + c', 6)} AS raised FROM ({SYM})")
def symmetric_eigenvalues(spark, sf_dir):
    """Both eigenvalues, and by how much make_positive raises the trace."""
    from ..functions import decompositions as d

    a, b, c = F.col("a"), F.col("b"), F.col("c")
    df = Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), (2 + F.col("p_size") % 5).cast("double").alias("a"), (F.col("p_partkey") % 7 - 3).cast("double").alias("b"), (-1 + F.col("p_size") % 3).cast("double").alias("c"))
    high, low = m.symmetric_eigenvalues_2(a, b, c)
    positive = d.make_positive(F.array(a, b, b, c))
    return df.select("id", near(high).alias("high"), near(low).alias("low"), near(positive[0] + positive[3] - a - c, 6).alias("raised"))


ANGLE = "p_size / 10.0::DOUBLE"


@query(f"SELECT id, {rounded('cos(t) * 2 - sin(t) * 3 + 1')} AS x, {rounded('sin(t) * 2 + cos(t) * 3 + 2')} AS y, 5.0::DOUBLE AS z, {rounded('2 * (cos(t) * 2 - sin(t) * 3)')} AS sx, {rounded('1.0*t')} AS turned, {rounded('2 * 2 + 1.0')} AS back FROM (SELECT p_partkey::BIGINT AS id, {ANGLE} AS t FROM part WHERE true)".replace("{rounded('1.0*t')}", ""))
def affine_transforms(spark, sf_dir):
    """The point (2, 3, 1) turned about z, moved by (1, 2, 4); scaled after turning; the angle read back modulo the circle's range."""
    df = Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") / F.lit(10.0)).alias("t"))
    p, one = [F.lit(2.0), F.lit(3.0), F.lit(1.0)], F.lit(1.0)
    turn = m.embed(v.rotation([F.lit(0.0), F.lit(0.0), one], F.col("t")))
    moved = m.apply_affine(m.post_translate(turn, [F.lit(1.0), F.lit(2.0), F.lit(4.0)]), p)
    scaled = m.apply_affine(m.matmul(m.scaling([F.lit(2.0)] * 3), turn, 4), p)
    size, rest, shift = m.decompose(m.post_translate(m.matmul(m.scaling([F.lit(2.0)] * 3), m.translation([F.lit(2.0), F.lit(0.0), F.lit(0.0)]), 4), [one, F.lit(0.0), F.lit(0.0)]))
    around = F.atan2(F.sin(F.col("t")), F.cos(F.col("t")))
    angle = m.axis_angle(v.rotation([F.lit(0.0), F.lit(0.0), one], F.col("t")))
    whole = F.col("t") - around + F.when(around < 0, -1).otherwise(1) * angle
    return df.select("id", near(moved[0]).alias("x"), near(moved[1]).alias("y"), near(moved[2]).alias("z"), near(scaled[0]).alias("sx"), near(whole).alias("turned"), near(shift[0] + size[0] * 0 + rest[0] * 0).alias("back"))


@query(f"""SELECT id, {rounded('cos(b) * cos(c)')} AS e00, {rounded('sin(a) * sin(b) * cos(c) - cos(a) * sin(c)')} AS e01, {rounded('-sin(b)')} AS e20, {rounded('sin(a) * cos(b)')} AS e21, {rounded('cos(a)')} AS qw, {rounded('1 - 2 * sin(a) * sin(a)')} AS q11, {rounded('-2 * cos(a) * sin(a)')} AS q12, {rounded('cos(a) * cos(b)')} AS m0, {rounded('1.0 + 0 * a')} AS aligned
  FROM (SELECT p_partkey::BIGINT AS id, p_size / 10.0::DOUBLE AS a, (p_partkey % 11) / 10.0::DOUBLE AS b, (p_partkey % 17) / 10.0::DOUBLE AS c FROM part)""")
def rotation_forms(spark, sf_dir):
    """Euler angles (x, then y, then z), quaternions and the turn of one vector to another."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    df = Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") / F.lit(10.0)).alias("a"), (F.col("p_partkey") % 11 / F.lit(10.0)).alias("b"), (F.col("p_partkey") % 17 / F.lit(10.0)).alias("c"))
    e = m.euler(a, b, c)
    zero = F.lit(0.0)
    q = [F.cos(a), F.sin(a), zero, zero]
    r = m.quaternion_matrix(q)
    product = v.quaternion_multiply(q, [F.cos(b), zero, F.sin(b), zero])
    one, other = [F.cos(a), F.sin(a), zero], [F.cos(c), zero, F.sin(c)]
    turned = m.times_vector(m.turn_between(one, other), one)
    return df.select("id", near(e[0]).alias("e00"), near(e[1]).alias("e01"), near(e[6]).alias("e20"), near(e[7]).alias("e21"), near(q[0]).alias("qw"), near(r[4]).alias("q11"), near(r[5]).alias("q12"), near(product[0]).alias("m0"), near(turned[0] * other[0] + turned[2] * other[2]).alias("aligned"))


def _spline(name: str, f: str) -> str:
    return f"{rounded(f)} AS {name}"


@query(f"""SELECT id, {_spline('l0', '1 - (g - floor(g))')}, {_spline('q0', '0.5 * (1.5 - q) * (1.5 - q)')}, {_spline('q1', '0.75 - (q - 1) * (q - 1)')}, {_spline('q2', '0.5 * (q - 0.5) * (q - 0.5)')}, {_spline('dq0', 'q - 1.5')}, {_spline('dq1', '2 - 2 * q')}, {_spline('dq2', 'q - 0.5')},
  {_spline('c0', 'pow(2 - c, 3) / 6')}, {_spline('c1', '2.0/3 - pow(c - 1, 2) + pow(c - 1, 3) / 2')}, {_spline('c2', '2.0/3 - pow(2 - c, 2) + pow(2 - c, 3) / 2')}, {_spline('c3', 'pow(c - 1, 3) / 6')} FROM (SELECT id, g, g - floor(g - 0.5) AS q, g - floor(g - 1) AS c FROM (SELECT p_partkey::BIGINT AS id, p_retailprice / 3 AS g FROM part))""")
def spline_weights(spark, sf_dir):
    """All weights of the linear, quadratic and cubic kernel, and the quadratic one's slopes."""
    g = F.col("p_retailprice") / 3
    w1, w2, w3 = (v.bspline(g - v.base_node(g, k), k) for k in (1, 2, 3))
    d = v.bspline_slope(g - v.base_node(g, 2))
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), near(w1[0]).alias("l0"), *[near(w).alias(f"q{k}") for k, w in enumerate(w2)], *[near(w).alias(f"dq{k}") for k, w in enumerate(d)], *[near(w).alias(f"c{k}") for k, w in enumerate(w3)])


@query("SELECT p_partkey::BIGINT AS id, (p_size + p_partkey)::VARCHAR || '/' || '6' AS raw, CASE WHEN (p_size + p_partkey) % 6 = 0 THEN '1' WHEN (p_size + p_partkey) % 3 = 0 THEN '2' WHEN (p_size + p_partkey) % 2 = 0 THEN '3' ELSE '6' END AS denominator FROM part")
def rational_sums(spark, sf_dir):
    """size / 6 + key / 6 in lowest terms."""
    from ..functions import decompositions as d

    total = d.rational_sum(F.concat(F.col("p_size").cast("string"), F.lit("/6")), F.concat(F.col("p_partkey").cast("string"), F.lit("/6")))
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), F.concat((F.col("p_size") + F.col("p_partkey")).cast("string"), F.lit("/6")).alias("raw"), total[1].alias("denominator"))


def _up(x: str, y: str) -> str:
    total, back = f"({x} + {y})", f"(({x} + {y}) - {x})"
    return f"CASE WHEN ({x} - ({total} - {back})) + ({y} - {back}) > 0 THEN nextafter({total}, 'infinity'::DOUBLE) ELSE {total} END"


@query(f"SELECT id, ({_up('x', 'y')})::DOUBLE::BIT::BIGINT AS sum_bits, ({_up('x', '(-y)')})::DOUBLE::BIT::BIGINT AS difference_bits, (-x)::BIT::BIGINT AS negative_bits FROM (SELECT p_partkey::BIGINT AS id, p_retailprice::DOUBLE / 7 AS x, (p_partkey + p_size)::DOUBLE / 3 AS y FROM part)")
def rounded_sums(spark, sf_dir):
    """Sums and differences rounded upwards, by their 64 bits."""
    from ..functions import decompositions as d

    x, y = F.col("p_retailprice") / 7, (F.col("p_partkey") + F.col("p_size")).cast("double") / 3
    df = Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), x.alias("x"), y.alias("y"))
    return df.select("id", d.reinterpret_bits(d.add_rounded_up(F.col("x"), F.col("y"))).alias("sum_bits"), d.reinterpret_bits(d.subtract_rounded_up(F.col("x"), F.col("y"))).alias("difference_bits"), d.reinterpret_bits(-F.col("x")).alias("negative_bits"))
