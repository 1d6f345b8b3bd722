"""Elastic energies, stresses and plastic return maps on principal values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lame(young: Column, poisson: Column) -> tuple[Column, Column]:
    """(mu, lambda)"""
    return young / (2 * (1 + poisson)), young * poisson / ((1 + poisson) * (1 - 2 * poisson))


def pressure(volume_ratio: Column, bulk: Column, gamma: int = 7) -> Column:
    return bulk * (F.pow(volume_ratio, F.lit(-float(gamma))) - 1)


def neo_hookean(s: list[Column], mu: Column, lam: Column) -> Column:
    j = s[0] * s[1] * s[2]
    log_j = F.log(j)
    return mu / 2 * (s[0] * s[0] + s[1] * s[1] + s[2] * s[2] - 3) - mu * log_j + lam / 2 * log_j * log_j


def fixed_corotated(s: list[Column], mu: Column, lam: Column) -> Column:
    j = s[0] * s[1] * s[2]
    return mu * ((s[0] - 1) * (s[0] - 1) + (s[1] - 1) * (s[1] - 1) + (s[2] - 1) * (s[2] - 1)) + lam / 2 * (j - 1) * (j - 1)


def hencky(s: list[Column], mu: Column, lam: Column) -> Column:
    e = [F.log(x) for x in s]
    trace = e[0] + e[1] + e[2]
    return mu * (e[0] * e[0] + e[1] * e[1] + e[2] * e[2]) + lam / 2 * trace * trace


def von_mises_scale(strain: list[Column], mu: Column, yield_stress: Column) -> Column:
    """Factor on the deviatoric strain that returns it to the yield surface."""
    mean = (strain[0] + strain[1] + strain[2]) / 3
    d = [e - mean for e in strain]
    size = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    most = yield_stress / (2 * mu)
    return F.when(size <= most, 1.0).otherwise(most / F.when(size == 0, 1.0).otherwise(size))


def sound_speed(bulk: Column, mu: Column, density: Column) -> Column:
    return F.sqrt((bulk + 4.0 / 3 * mu) / density)


def cfl_step(dx: Column, speed: Column, cfl: Column) -> Column:
    return cfl * dx / speed


def _sum(terms: list[Column]) -> Column:
    return terms[0] + terms[1] + terms[2]


def state_energy(j: Column, bulk: Column) -> Column:
    """Energy, stress and its slope of an equation of state with exponent 7, of the volume ratio."""
    return bulk * (1 / (6 * j * j * j * j * j * j) + j)


def state_stress(j: Column, bulk: Column) -> Column:
    return bulk - bulk / (j * j * j * j * j * j * j)


def state_stress_slope(j: Column, bulk: Column) -> Column:
    return 7 * bulk / (j * j * j * j * j * j * j * j)


def fixed_corotated_stress(s: list[Column], mu: Column, lam: Column) -> list[Column]:
    """Of the energy above, by each principal stretch."""
    j = s[0] * s[1] * s[2]
    others = [s[1] * s[2], s[0] * s[2], s[0] * s[1]]
    return [2 * mu * (s[k] - 1) + lam * (j - 1) * others[k] for k in range(3)]


def neo_hookean_stress(s: list[Column], mu: Column, lam: Column) -> list[Column]:
    log_j = F.log(s[0] * s[1] * s[2])
    return [mu * (x - 1 / x) + lam * log_j / x for x in s]


def stable_neo_hookean(s: list[Column], mu: Column, lam: Column) -> Column:
    """Defined for inverted elements too."""
    j = s[0] * s[1] * s[2]
    return mu / 2 * (s[0] * s[0] + s[1] * s[1] + s[2] * s[2] - 3) - mu * (j - 1) + lam / 2 * (j - 1) * (j - 1)


def stable_neo_hookean_stress(s: list[Column], mu: Column, lam: Column) -> list[Column]:
    j = s[0] * s[1] * s[2]
    others = [s[1] * s[2], s[0] * s[2], s[0] * s[1]]
    return [mu * s[k] + (lam * (j - 1) - mu) * others[k] for k in range(3)]


def hencky_stress(s: list[Column], mu: Column, lam: Column) -> list[Column]:
    e = [F.log(x) for x in s]
    return [(2 * mu * e[k] + lam * _sum(e)) / s[k] for k in range(3)]


def kirchhoff(s: list[Column], stress: list[Column], volume: Column) -> list[Column]:
    """Principal Kirchhoff stress times volume, from the first Piola stress by stretch."""
    return [x * p * volume for x, p in zip(s, stress, strict=True)]


def drucker_prager(s: list[Column], mu: Column, lam: Column, friction: float = 35.0) -> list[Column]:
    """Stretches returned to the cone of a dry granular material; friction is its angle in degrees."""
    from math import pi, sin, sqrt

    sine = sin(friction / 180 * pi)
    alpha = sqrt(2 / 3) * 2 * sine / (3 - sine)
    e = [F.log(x) for x in s]
    trace = _sum(e)
    d = [x - trace / 3 for x in e]
    size = F.sqrt(_sum([x * x for x in d]))
    loose = (size <= 128 * 2.220446049250313e-16) | (trace > 0)
    excess = size + (3 * lam + 2 * mu) / (2 * mu) * trace * alpha
    scale = excess / F.when(size > 0, size)
    return [F.when(loose, 1.0).when(excess <= 0, x).otherwise(F.exp(e[k] - scale * d[k])) for k, x in enumerate(s)]


def von_mises(s: list[Column], mu: Column, yield_stress: Column) -> list[Column]:
    """Stretches whose scaled deviatoric part is brought back to the yield surface, volume not kept exactly."""
    b = [x * x for x in s]
    mean = _sum(b) / 3
    scaled_mu = mu * F.pow(s[0] * s[1] * s[2], F.lit(-2.0 / 3))
    d = [scaled_mu * (x - mean) for x in b]
    size = F.sqrt(_sum([x * x for x in d]))
    excess = size - F.lit((2 / 3) ** 0.5) * yield_stress
    inside = excess < 1e-4
    factor = excess / scaled_mu / F.when(size > 0, size)
    return [F.when(inside, x).otherwise(F.sqrt(b[k] - factor * d[k])) for k, x in enumerate(s)]


def snow(s: list[Column], mu: Column, lam: Column, compression: float = 2e-2, stretch: float = 7.5e-3, hardening: float = 5.0) -> tuple[list[Column], Column, Column]:
    """Stretches clamped to what snow bears, and both parameters hardened by the volume it has lost."""
    held = [F.greatest(F.least(x, F.lit(1 + stretch)), F.lit(1 - compression)) for x in s]
    lost = s[0] * s[1] * s[2] / F.greatest(held[0] * held[1] * held[2], F.lit(1e-6))
    factor = F.exp(hardening * (1 - lost))
    return held, mu * factor, lam * factor


def cam_clay_tips(s: list[Column], mu: Column, lam: Column, log_jp: Column, beta: float = 2.0, xi: float = 3.0) -> tuple[Column, Column]:
    """(case, log_jp) of a clay's trial state: 1 and 2 beyond the tips of its ellipsoid, with the hardening that the
    projection brings, 3 between them."""
    kappa = lam + mu * 2 / 3
    p0 = kappa * (1e-5 + xi * F.sinh(F.greatest(-log_jp, F.lit(0.0))))
    j = s[0] * s[1] * s[2]
    pressure_ = -kappa / 2 * (j - 1 / j) * j
    case = F.when(pressure_ > p0, 1).when(pressure_ < -beta * p0, 2).otherwise(3)
    new = F.when(case == 1, F.sqrt(F.greatest(1 - 2 * p0 / kappa, F.lit(0.0)))).when(case == 2, F.sqrt(1 + 2 * beta * p0 / kappa))
    return case, F.when(case < 3, log_jp + F.log(j / F.when(new > 0, new))).otherwise(log_jp)
