"""Scalar, bit and hash functions as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.when(x < low, low).when(high < x, high).otherwise(x)


def near_zero(x: Column) -> Column:
    return F.abs(x) <= F.lit(128 * 2.220446049250313e-16)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps folded over a fixed sequence; 93 steps settle any two 64-bit numbers."""
    start = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step)["a"]


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0)).otherwise(F.abs(F.expr("0") + a.cast("long") / F.when(g == 0, 1).otherwise(g) * b.cast("long")).cast("long"))


def pow_integral(base: Column, exponent: Column) -> Column:
    return F.when(exponent < 0, F.lit(0.0)).otherwise(F.pow(base, exponent))


def copysign(size: Column, sign: Column) -> Column:
    return F.when(sign < 0, -F.abs(size)).otherwise(F.abs(size))


def log_1px_over_x(x: Column, eps: float = 1e-6) -> Column:
    small = F.abs(x) < eps
    return F.when(small, 1 - x / 2 + x * x / 3).otherwise(F.log1p(x) / F.when(small, F.lit(1.0)).otherwise(x))


def diff_log_over_diff(x: Column, y: Column, eps: float = 1e-6) -> Column:
    """(ln x - ln y) / (x - y)."""
    return log_1px_over_x(x / y - 1, eps) / y


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def lower_trunc(x: Column) -> Column:
    return F.floor(x).cast("long")


def smallest_positive_quadratic_root(a: Column, b: Column, c: Column, tolerance: float = 1e-12) -> Column:
    """Least positive root of a x^2 + b x + c; -1 if there is none. A double root counts as none."""
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    safe_a, safe_b = F.when(a == 0, 1.0).otherwise(a), F.when(b == 0, 1.0).otherwise(b)
    x1, x2 = (-b - root) / (2 * safe_a), (-b + root) / (2 * safe_a)
    low, high = F.least(x1, x2), F.greatest(x1, x2)
    quadratic = F.when(disc > 0, F.when(low > 0, low).when(high > 0, high).otherwise(-1.0)).otherwise(-1.0)
    line = -c / safe_b
    linear = F.when(F.abs(b) <= tolerance, -1.0).otherwise(F.when(line > 0, line).otherwise(-1.0))
    return F.when(F.abs(a) <= tolerance, linear).otherwise(quadratic)


def newton_sqrt(x: Column, steps: int = 60) -> Column:
    guess = F.greatest(x, F.lit(1.0))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), guess, lambda g, _: (g + x / g) / 2)
    return F.when(x <= 0, 0.0).otherwise(found)


def poisson_pdf(k: Column, mean: Column) -> Column:
    return F.exp(k * F.log(mean) - mean) / F.factorial(k.cast("int"))


def normal_pdf(x: Column, mean: Column, deviation: Column) -> Column:
    z = (x - mean) / deviation
    return F.exp(-z * z / 2) / (deviation * F.lit(2.5066282746310002))


def expand_bits(x: Column, bits: int = 10) -> Column:
    """Two zero bits between the bits of x."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), k).bitwiseAND(1), 3 * k))
    return out


def compact_bits(x: Column, bits: int = 10) -> Column:
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), 3 * k).bitwiseAND(1), k))
    return out


def morton_3d(x: Column, y: Column, z: Column, bits: int = 10) -> Column:
    """Interleaved bits of three numbers in [0, 1), x highest."""
    cell = lambda v: F.least(F.greatest(F.floor(v * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    return F.shiftleft(expand_bits(cell(x), bits), 2).bitwiseOR(F.shiftleft(expand_bits(cell(y), bits), 1)).bitwiseOR(expand_bits(cell(z), bits))


def round_down(n: Column, power: int) -> Column:
    return n.cast("long").bitwiseAND(~(power - 1))


def round_up(n: Column, power: int) -> Column:
    return (n.cast("long") + (power - 1)).bitwiseAND(~(power - 1))


def bit_length(n: Column) -> Column:
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n.cast("long")))).cast("int")


def bits_for(n: Column) -> Column:
    """Digits that number 0 .. n-1."""
    return bit_length(n - 1)


def next_power_of_two(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit_length(n - 1))


def leading_zeros(n: Column, width: int = 64) -> Column:
    return F.lit(width) - bit_length(n)


def trailing_zeros(n: Column, width: int = 64) -> Column:
    lowest = n.cast("long").bitwiseAND(-n.cast("long"))
    return F.when(n == 0, width).otherwise(bit_length(lowest) - 1).cast("int")


def reverse_bits(n: Column, width: int = 32) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(n.cast("long")), width, "0")), 2, 10).cast("long")


def bit_pack(value: Column, mask: int) -> Column:
    """The bits of value at the places of mask, side by side."""
    out, k = F.lit(0).cast("long"), 0
    for place in range(63):
        if mask >> place & 1:
            out = out.bitwiseOR(F.shiftleft(F.shiftright(value.cast("long"), place).bitwiseAND(1), k))
            k += 1
    return out


def bit_spread(value: Column, mask: int) -> Column:
    out, k = F.lit(0).cast("long"), 0
    for place in range(63):
        if mask >> place & 1:
            out = out.bitwiseOR(F.shiftleft(F.shiftright(value.cast("long"), k).bitwiseAND(1), place))
            k += 1
    return out


def bits_before(mask: Column, place: Column) -> Column:
    """Number of bits set below a place."""
    return F.bit_count(mask.cast("long").bitwiseAND(F.expr("1L") * F.pow(F.lit(2), place).cast("long") - 1)).cast("int")


def mix32(x: Column) -> Column:
    """A reversible 32-bit mixer on longs: products are split so that they never overflow."""
    def times(v: Column, m: int) -> Column:
        low, high = v.bitwiseAND(0xFFFF), F.shiftright(v, 16)
        return (low * m + F.shiftleft((high * m).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)

    x = x.cast("long").bitwiseAND(0xFFFFFFFF)
    x = times(x.bitwiseXOR(F.shiftright(x, 16)), 0x85EBCA6B)
    x = times(x.bitwiseXOR(F.shiftright(x, 13)), 0xC2B2AE35)
    return x.bitwiseXOR(F.shiftright(x, 16))


def complex_multiply(re: Column, im: Column, re2: Column, im2: Column) -> Column:
    return F.struct((re * re2 - im * im2).alias("re"), (re * im2 + im * re2).alias("im"))


def complex_exp(re: Column, im: Column) -> Column:
    return F.struct((F.exp(re) * F.cos(im)).alias("re"), (F.exp(re) * F.sin(im)).alias("im"))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def complex_number(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def complex_polar(size: Column, angle: Column) -> Column:
    return complex_number(size * F.cos(angle), size * F.sin(angle))


def complex_abs(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def complex_arg(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def complex_norm(z: Column) -> Column:
    return z["re"] * z["re"] + z["im"] * z["im"]


def complex_conj(z: Column) -> Column:
    return complex_number(z["re"], -z["im"])


def complex_divide(a: Column, b: Column) -> Column:
    def ratio(s: Column) -> Column:
        a, b = s["a"], s["b"]
        n = F.when(complex_norm(b) != 0, complex_norm(b))
        return complex_number((a["re"] * b["re"] + a["im"] * b["im"]) / n, (a["im"] * b["re"] - a["re"] * b["im"]) / n)

    return let(F.struct(a.alias("a"), b.alias("b")), ratio)


def complex_log(z: Column) -> Column:
    return let(z, lambda z: complex_number(F.log(complex_abs(z)), complex_arg(z)))


def complex_log10(z: Column) -> Column:
    return let(z, lambda z: complex_number(F.log10(complex_abs(z)), complex_arg(z) / F.log(F.lit(10.0))))


def complex_sqrt(z: Column) -> Column:
    """The root with a real part of 0 or more."""
    def root(w: Column) -> Column:
        size = complex_abs(w)
        re, im = F.sqrt((size + w["re"]) / 2), F.sqrt(F.greatest((size - w["re"]) / 2, F.lit(0.0)))
        return complex_number(re, F.when(w["im"] < 0, -im).otherwise(im))

    return let(z, root)


def complex_pow(a: Column, b: Column) -> Column:
    return let(let(complex_log(a), lambda log: complex_multiply(log["re"], log["im"], b["re"], b["im"])), lambda p: complex_exp(p["re"], p["im"]))


def complex_sin(z: Column) -> Column:
    return let(z, lambda z: complex_number(F.sin(z["re"]) * F.cosh(z["im"]), F.cos(z["re"]) * F.sinh(z["im"])))


def complex_cos(z: Column) -> Column:
    return let(z, lambda z: complex_number(F.cos(z["re"]) * F.cosh(z["im"]), -F.sin(z["re"]) * F.sinh(z["im"])))


def complex_tan(z: Column) -> Column:
    return let(z, lambda z: complex_divide(complex_sin(z), complex_cos(z)))


def complex_sinh(z: Column) -> Column:
    return let(z, lambda z: complex_number(F.sinh(z["re"]) * F.cos(z["im"]), F.cosh(z["re"]) * F.sin(z["im"])))


def complex_cosh(z: Column) -> Column:
    return let(z, lambda z: complex_number(F.cosh(z["re"]) * F.cos(z["im"]), F.sinh(z["re"]) * F.sin(z["im"])))


def complex_tanh(z: Column) -> Column:
    return let(z, lambda z: complex_divide(complex_sinh(z), complex_cosh(z)))


def complex_asinh(z: Column) -> Column:
    """log(z + sqrt(z^2 + 1))"""
    def inner(z: Column) -> Column:
        root = complex_sqrt(complex_number(z["re"] * z["re"] - z["im"] * z["im"] + 1, 2 * z["re"] * z["im"]))
        return complex_log(let(root, lambda r: complex_number(z["re"] + r["re"], z["im"] + r["im"])))

    return let(z, inner)


def complex_asin(z: Column) -> Column:
    """-i asinh(i z)"""
    return let(let(z, lambda z: complex_asinh(complex_number(-z["im"], z["re"]))), lambda t: complex_number(t["im"], -t["re"]))


def complex_acos(z: Column) -> Column:
    return let(complex_asin(z), lambda a: complex_number(F.lit(1.5707963267948966) - a["re"], -a["im"]))


def complex_acosh(z: Column) -> Column:
    """log(z + sqrt(z + 1) sqrt(z - 1))"""
    def inner(z: Column) -> Column:
        a, b = complex_sqrt(complex_number(z["re"] + 1, z["im"])), complex_sqrt(complex_number(z["re"] - 1, z["im"]))
        root = let(F.struct(a.alias("a"), b.alias("b")), lambda s: complex_multiply(s["a"]["re"], s["a"]["im"], s["b"]["re"], s["b"]["im"]))
        return complex_log(let(root, lambda r: complex_number(z["re"] + r["re"], z["im"] + r["im"])))

    return let(z, inner)


def complex_atanh(z: Column) -> Column:
    """(log(1 + z) - log(1 - z)) / 2"""
    def inner(z: Column) -> Column:
        a, b = complex_log(complex_number(1 + z["re"], z["im"])), complex_log(complex_number(1 - z["re"], -z["im"]))
        return let(F.struct(a.alias("a"), b.alias("b")), lambda s: complex_number((s["a"]["re"] - s["b"]["re"]) / 2, (s["a"]["im"] - s["b"]["im"]) / 2))

    return let(z, inner)


def complex_atan(z: Column) -> Column:
    """-i atanh(i z)"""
    return let(let(z, lambda z: complex_atanh(complex_number(-z["im"], z["re"]))), lambda t: complex_number(t["im"], -t["re"]))


def fma(a: Column, b: Column, c: Column) -> Column:
    return a * b + c


def fmod(a: Column, b: Column) -> Column:
    """The rest of a truncated division, with the sign of a; null for b = 0."""
    return a % F.when(b != 0, b)


def modf(x: Column) -> tuple[Column, Column]:
    """(whole part towards zero, rest), both with the sign of x."""
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")
    return whole, x - whole


def frexp(x: Column) -> tuple[Column, Column]:
    """(mantissa in [0.5, 1), exponent) with x = mantissa * 2**exponent; (0, 0) for 0."""
    guess = F.floor(F.log2(F.abs(F.when(x != 0, x)))) + 1
    m = x / F.pow(F.lit(2.0), guess)
    # The logarithm may be one off beside a power of two.
    shift = F.when(F.abs(m) >= 1, 1).when(F.abs(m) < 0.5, -1).otherwise(0)
    return F.coalesce(m / F.pow(F.lit(2.0), shift.cast("double")), F.lit(0.0)), F.coalesce(guess + shift, F.lit(0)).cast("int")


def ldexp(x: Column, exponent: Column) -> Column:
    return x * F.pow(F.lit(2.0), exponent.cast("double"))


def sqr(x: Column) -> Column:
    return x * x


def rsqrt(x: Column) -> Column:
    return 1 / F.sqrt(F.when(x > 0, x))


def diff_interlock_log_over_diff(x: Column, y: Column, log_y: Column, eps: float = 1e-6) -> Column:
    """(y ln x - x ln y) / (x - y)"""
    return log_y - y * diff_log_over_diff(x, y, eps)


def smallest_positive_cubic_root(a: Column, b: Column, c: Column, d: Column, tolerance: float = 1e-12) -> Column:
    """Least positive real root of a x^3 + b x^2 + c x + d; -1 if there is none. By the trigonometric and
    Cardano's form with two Newton steps; for a of no size, that of the quadratic."""
    flat = F.abs(a) <= tolerance
    lead = F.when(flat, 1.0).otherwise(a)

    def roots(e: Column) -> Column:
        p2, p1, p0 = e["p2"], e["p1"], e["p0"]

        def polished(x: Column) -> Column:
            def step(x: Column, _) -> Column:
                slope = (3 * x + 2 * p2) * x + p1
                return x - F.when(F.abs(slope) > tolerance, (((x + p2) * x + p1) * x + p0) / F.when(F.abs(slope) > tolerance, slope)).otherwise(0.0)

            return F.aggregate(F.sequence(F.lit(1), F.lit(2)), x, step)

        def found(t: Column) -> Column:
            q, r, disc = t["q"], t["r"], t["q"] * t["q"] * t["q"] + t["r"] * t["r"]
            root = F.sqrt(F.greatest(disc, F.lit(0.0)))
            size = F.sqrt(F.greatest(-q, F.lit(1e-60)))
            angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r / (size * size * size))))
            three = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: 2 * size * F.cos((angle + 2 * k * F.lit(3.141592653589793)) / 3) - p2 / 3)
            # Beside a double root the sign of disc is noise; the three cosines give that root twice.
            return F.when(disc > 1e-12 * (r * r + F.abs(q * q * q)), F.array(F.cbrt(r + root) + F.cbrt(r - root) - p2 / 3)).otherwise(three)

        some = let(F.struct(((3 * p1 - p2 * p2) / 9).alias("q"), ((9 * p2 * p1 - 27 * p0 - 2 * p2 * p2 * p2) / 54).alias("r")), found)
        return F.array_min(F.filter(F.transform(some, polished), lambda x: x > 0))

    cubic = let(F.struct((b / lead).alias("p2"), (c / lead).alias("p1"), (d / lead).alias("p0")), roots)
    return F.coalesce(F.when(flat, smallest_positive_quadratic_root(b, c, d, tolerance)).otherwise(cubic), F.lit(-1.0))


def _times32(v: Column, m: int) -> Column:
    """v * m modulo 2**32, by halves that never overflow a long."""
    low, high = v.bitwiseAND(0xFFFF), F.shiftright(v, 16)
    return (low * m + F.shiftleft((high * m).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)


def _rounds32(x: Column, m: int) -> Column:
    x = x.cast("long").bitwiseAND(0xFFFFFFFF)
    for _ in range(2):
        x = let(let(x, lambda v: v.bitwiseXOR(F.shiftright(v, 16))), lambda v: _times32(v, m))
    return let(x, lambda v: v.bitwiseXOR(F.shiftright(v, 16)))


def hash32(x: Column) -> Column:
    """A reversible hash of 32-bit numbers."""
    return _rounds32(x, 0x45D9F3B)


def unhash32(x: Column) -> Column:
    """The inverse of `hash32`: the same rounds by the factor's inverse modulo 2**32."""
    return _rounds32(x, pow(0x45D9F3B, -1, 1 << 32))


def hash_combine(seed: Column, value: Column) -> Column:
    """A 32-bit hash of a seed and a value: seed ^ (value + 0x9e3779b9 + (seed << 6) + (seed >> 2))."""
    seed, value = seed.cast("long").bitwiseAND(0xFFFFFFFF), value.cast("long").bitwiseAND(0xFFFFFFFF)
    return seed.bitwiseXOR((value + 0x9E3779B9 + F.shiftleft(seed, 6) + F.shiftright(seed, 2)).bitwiseAND(0xFFFFFFFF))


def interleaved_mask(every: int, bits: int = 63) -> int:
    """A number with each `every`-th bit set, from the lowest on."""
    return sum(1 << k for k in range(0, bits, every))


def unit_float(bits: Column) -> Column:
    """32 bits to a number in [0, 1): the upper 23 are its fraction."""
    return F.shiftright(bits.cast("long").bitwiseAND(0xFFFFFFFF), 9) / F.lit(float(1 << 23))


def find_first_set(n: Column) -> Column:
    """1-based place of the lowest set bit, 0 for 0."""
    return F.when(n == 0, 0).otherwise(trailing_zeros(n) + 1).cast("int")


def set_bit(mask: Column, place: int, on: bool = True) -> Column:
    one = F.lit(1 << place)
    return mask.cast("long").bitwiseOR(one) if on else mask.cast("long").bitwiseAND(F.lit(~(1 << place)))


def toggle_bit(mask: Column, place: int) -> Column:
    return mask.cast("long").bitwiseXOR(F.lit(1 << place))


def mask_minus(a: Column, b: Column) -> Column:
    return a.cast("long").bitwiseAND(F.bitwise_not(b.cast("long")))


def half_away(x: Column, digits: int) -> Column:
    """A double rounded to so many digits as C's round does: scaled, half away from 0, scaled back.

    Spark's round goes through the shortest decimal of the double, which lies on the other side of some ties. Numbers too
    large for a fraction are scaled there and back all the same, unless that overflows; a zero keeps the sign of `x`."""
    if not isinstance(x, Column):
        scaled = np.abs(x) * 10.0**digits
        whole = np.floor(scaled)
        large = np.where(np.isfinite(scaled), x * 10.0**digits / 10.0**digits, x)
        return np.where(scaled < 2.0**52, np.sign(x) * (whole + (scaled - whole >= 0.5)) / 10.0**digits, large)
    scaled = F.abs(x) * F.lit(10.0**digits)
    whole = F.floor(scaled).cast("double")
    return F.when(scaled < F.lit(2.0**52), F.signum(x) * (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)).when(scaled < float("inf"), x * F.lit(10.0**digits) / F.lit(10.0**digits)).otherwise(x)
