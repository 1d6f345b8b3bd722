"""Exact signs of whole-number polynomials at the roots of another one, by Sturm chains; a small helper for columns.

A polynomial is a list of coefficients, lowest first, without zeros at its end; [] is zero."""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm


def trim(p: list) -> list:
    n = len(p)
    while n and not p[n - 1]:
        n -= 1
    return list(p[:n])


def plus(a: list, b: list, sign: int = 1) -> list:
    return trim([(a[k] if k < len(a) else 0) + sign * (b[k] if k < len(b) else 0) for k in range(max(len(a), len(b)))])


def minus(a: list, b: list) -> list:
    return plus(a, b, -1)


def times(a: list, b: list) -> list:
    out = [0] * max(len(a) + len(b) - 1, 0)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return trim(out)


def divided(a: list, b: list) -> tuple[list, list]:
    a, out = [Fraction(x) for x in a], []
    while len(a) >= len(b):
        k = a[-1] / b[-1]
        out.append(k)
        for j in range(1, len(b) + 1):
            a[-j] -= k * b[-j]
        a.pop()
    return trim(out[::-1]), trim(a)


def common(a: list, b: list) -> list:
    """Greatest common divisor, leading coefficient 1."""
    while b:
        a, b = b, divided(a, b)[1]
    return [Fraction(x) / a[-1] for x in a]


def whole(p: list) -> list[int]:
    """The same signs and roots in whole numbers without a common factor."""
    unit = lcm(*[x.denominator for x in p])
    out = [int(x * unit) for x in p]
    shared = gcd(*out)
    return [x // shared for x in out] if shared > 1 else out


def at(p: list[int], t: Fraction) -> int:
    """p(t) times the denominator of t to the power of p's degree."""
    n, d, out, scale = t.numerator, t.denominator, 0, 1
    for x in reversed(p):
        out = out * n + x * scale
        scale *= d
    return out


def slope(p: list) -> list:
    return [k * x for k, x in enumerate(p)][1:]


#: A sign is taken from a range this short first, if the slope of the polynomial allows; the rest is settled by chains.
SURE = Fraction(1, 2**24)


class Chain:
    """Counts the different roots of a polynomial that is not zero in half-open ranges (lo, hi]."""

    def __init__(self, p: list):
        self.plain = whole(divided(p, common(p, slope(p)))[0] if len(p) > 2 else p)
        self.parts = [self.plain]
        step = slope(self.plain)
        while step:
            self.parts.append(step)
            step = whole([-x for x in divided(self.parts[-2], step)[1]])

    def changes(self, t) -> int:
        signs = [v > 0 for v in (at(p, t) for p in self.parts) if v]
        return sum(x != y for x, y in zip(signs, signs[1:], strict=False))

    def count(self, lo, hi) -> int:
        return self.changes(lo) - self.changes(hi)


class Root:
    """The one root of a chain in (lo, hi]; lo == hi is a known place."""

    def __init__(self, chain: Chain | None, lo, hi):
        self.chain, self.lo, self.hi = chain, lo, hi

    def halve(self) -> None:
        p, mid = self.chain.plain, (self.lo + self.hi) / 2
        upper, v = at(p, self.hi), at(p, mid)
        if upper == 0 or v == 0:
            self.lo = self.hi = self.hi if upper == 0 else mid
        elif (v > 0) == (upper > 0):
            self.hi = mid
        else:
            self.lo = mid

    def sign(self, g: list[int]) -> int:
        if not g:
            return 0
        while self.hi - self.lo > SURE:
            self.halve()
        v = at(g, self.hi)
        if self.lo != self.hi and abs(v) <= (self.hi - self.lo) * sum(k * abs(x) for k, x in enumerate(g)) * self.hi.denominator ** (len(g) - 1):
            shared = common(self.chain.plain, g)
            if len(shared) > 1 and Chain(shared).count(self.lo, self.hi):
                return 0
            own = Chain(g)
            while own.count(self.lo, self.hi):
                self.halve()
            v = at(g, self.hi)
        return (v > 0) - (v < 0)

    def place(self) -> float:
        """Within 2^-52 of the root."""
        while self.hi - self.lo > Fraction(1, 2**52):
            self.halve()
        return float(self.hi)


def in_unit_range(p: list) -> list[Root]:
    """Roots in [0, 1], in order, of a polynomial that is not zero."""
    chain = Chain(p)
    out = [] if p[0] else [Root(None, Fraction(0), Fraction(0))]
    todo = [(Fraction(0), Fraction(1))]
    while todo:
        lo, hi = todo.pop()
        n = chain.count(lo, hi)
        if n == 1:
            out.append(Root(chain, lo, hi))
        elif n > 1:
            mid = (lo + hi) / 2
            todo += [(mid, hi), (lo, mid)]
    return out
