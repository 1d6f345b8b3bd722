"""Queries: elastic stresses, plastic return maps, fused transfers, level-set upkeep and expression kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import materials as m
from ..operators import grid, kernels
from .registry import Tables, query

STRETCH = "SELECT p_partkey::BIGINT AS id, 0.8 + p_size / 100.0::DOUBLE AS s0, 1 + (p_partkey % 17) / 100.0::DOUBLE AS s1, 0.9 + (p_partkey % 23) / 200.0::DOUBLE AS s2 FROM part"


def stretches(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), (0.8 + F.col("p_size") / F.lit(100.0)).alias("s0"), (1 + F.col("p_partkey") % 17 / F.lit(100.0)).alias("s1"), (0.9 + F.col("p_partkey") % 23 / F.lit(200.0)).alias("s2"))


def S():  # noqa: N802
    return [F.col(f"s{k}") for k in range(3)]


def near(c, digits: int = 7):
    """Rounded; the shift keeps values that are short decimals off the ties, where the last bit would decide."""
    return F.round(c + 3e-9, digits) + F.lit(0.0)


def r(sql: str, digits: int = 7) -> str:
    return f"round({sql} + 3e-9, {digits}) + 0.0"


MU, LAM = 3.0, 5.0
J = "(s0 * s1 * s2)"
LOGS = "(ln(s0) + ln(s1) + ln(s2))"


@query(f"SELECT id, {r(f'2 * (1 / (6 * pow({J}, 6)) + {J})')} AS state, {r(f'2 - 2 / pow({J}, 7)')} AS state_stress, {r(f'14 / pow({J}, 8)')} AS state_slope, {r(f'6 * (s0 - 1) + 5 * ({J} - 1) * s1 * s2')} AS corotated0, {r(f'3 * (s1 - 1 / s1) + 5 * ln({J}) / s1')} AS neo1, {r(f'1.5 * (s0*s0 + s1*s1 + s2*s2 - 3) - 3 * ({J} - 1) + 2.5 * pow({J} - 1, 2)')} AS stable, {r(f'3 * s2 + (5 * ({J} - 1) - 3) * s0 * s1')} AS stable2, {r(f'(6 * ln(s0) + 5 * {LOGS}) / s0')} AS hencky0, {r(f'0.5 * (6 * ln(s0) + 5 * {LOGS})')} AS kirchhoff0 FROM ({STRETCH})")
def stresses(spark, sf_dir):
    j, bulk, h = S()[0] * S()[1] * S()[2], F.lit(2.0), m.hencky_stress(S(), F.lit(MU), F.lit(LAM))
    return stretches(spark, sf_dir).select("id", near(m.state_energy(j, bulk)).alias("state"), near(m.state_stress(j, bulk)).alias("state_stress"), near(m.state_stress_slope(j, bulk)).alias("state_slope"), near(m.fixed_corotated_stress(S(), F.lit(MU), F.lit(LAM))[0]).alias("corotated0"), near(m.neo_hookean_stress(S(), F.lit(MU), F.lit(LAM))[1]).alias("neo1"), near(m.stable_neo_hookean(S(), F.lit(MU), F.lit(LAM))).alias("stable"), near(m.stable_neo_hookean_stress(S(), F.lit(MU), F.lit(LAM))[2]).alias("stable2"), near(h[0]).alias("hencky0"), near(m.kirchhoff(S(), h, F.lit(0.5))[0]).alias("kirchhoff0"))


_ALPHA = "(sqrt(2.0::DOUBLE / 3) * 2 * sin(35 / 180.0::DOUBLE * pi()) / (3 - sin(35 / 180.0::DOUBLE * pi())))"


@query(f"""SELECT id, {r('CASE WHEN size < 3e-14 OR tr > 0 THEN 1 WHEN ex <= 0 THEN s0 ELSE exp(ln(s0) - ex / size * (ln(s0) - tr / 3)) END')} AS sand0, {r('CASE WHEN vsize - sqrt(2.0::DOUBLE / 3) * 0.4 < 1e-4 THEN s1 ELSE sqrt(s1 * s1 - (vsize - sqrt(2.0::DOUBLE / 3) * 0.4) / smu / vsize * smu * (s1 * s1 - vm)) END')} AS metal1, {r('greatest(least(s2, 1.0075), 0.98)')} AS snow2, {r('3 * exp(5 * (1 - j / (greatest(least(s0, 1.0075), 0.98) * greatest(least(s1, 1.0075), 0.98) * greatest(least(s2, 1.0075), 0.98))))', 5)} AS snow_mu, CASE WHEN p > p0 THEN 1 WHEN p < -2 * p0 THEN 2 ELSE 3 END AS clay, {r('CASE WHEN p > p0 THEN -0.05 + ln(j / sqrt(1 - 2 * p0 / 7)) WHEN p < -2 * p0 THEN -0.05 + ln(j / sqrt(1 + 4 * p0 / 7)) ELSE -0.05 END')} AS hardened
  FROM (SELECT *, size + 21.0 / 6 * tr * {_ALPHA} AS ex, sqrt(pow(smu * (s0*s0 - vm), 2) + pow(smu * (s1*s1 - vm), 2) + pow(smu * (s2*s2 - vm), 2)) AS vsize, -3.5 * (j - 1 / j) * j AS p, 7 * (1e-5 + 3 * (exp(0.05) - exp(-0.05)) / 2) AS p0
  FROM (SELECT *, {LOGS} AS tr, {J} AS j, (s0*s0 + s1*s1 + s2*s2) / 3 AS vm, 3 * pow({J}, -2.0::DOUBLE / 3) AS smu, sqrt(pow(ln(s0) - {LOGS} / 3, 2) + pow(ln(s1) - {LOGS} / 3, 2) + pow(ln(s2) - {LOGS} / 3, 2)) AS size FROM ({STRETCH})))""")
def return_maps(spark, sf_dir):
    held, mu, _ = m.snow(S(), F.lit(MU), F.lit(LAM))
    case, hardened = m.cam_clay_tips(S(), F.lit(MU), F.lit(LAM), F.lit(-0.05))
    return stretches(spark, sf_dir).select("id", near(m.drucker_prager(S(), F.lit(MU), F.lit(LAM))[0]).alias("sand0"), near(m.von_mises(S(), F.lit(MU), F.lit(0.4))[1]).alias("metal1"), near(held[2]).alias("snow2"), near(mu, 5).alias("snow_mu"), case.alias("clay"), near(hardened).alias("hardened"))


@query("SELECT p_partkey::BIGINT AS id, round(p_retailprice * 0.5 + sin(p_size), 6) AS x, p_size % 3 = 0 AS hit FROM part")
def expression_kernel(spark, sf_dir):
    """A script over channels, compiled by the engine from its text."""
    df = Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), F.col("p_retailprice").alias("x"), F.col("p_size").alias("n"))
    out = kernels.run(df, "y = x * scale; x = y + sin(n); hit = n % 3 = 0", {"scale": 0.5})
    return out.select("id", F.round("x", 6).alias("x"), "hit")


@query("SELECT event_id::BIGINT AS id, CASE event_type WHEN 'click' THEN round(value * 2, 6) WHEN 'view' THEN round(value + 1, 6) ELSE -1.0 END AS v FROM events")
def variant_dispatch(spark, sf_dir):
    df = Tables(spark, sf_dir).events
    return df.select(F.col("event_id").cast("long").alias("id"), F.round(kernels.match(F.col("event_type"), {"click": F.col("value") * 2, "view": F.col("value") + 1}, F.lit(-1.0)), 6).alias("v"))


@query("SELECT user_id, string_agg(s, '' ORDER BY event_id) AS path FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'r' WHEN sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER w > 0 AND event_id % 3 = 1 THEN 'g' ELSE 'b' END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1")
def state_machine(spark, sf_dir):
    """Signals 0 arm the machine (r); an armed one answers 1 with g, everything else with b."""
    df = Tables(spark, sf_dir).events.select("user_id", "event_id", (F.col("event_id") % 3).alias("signal"))
    step = lambda state, x: F.when(x == 0, "armed").otherwise(state)
    shown = lambda state, x: F.when(x == 0, "r").when((state == "armed") & (x == 1), "g").otherwise("b")
    return kernels.machine(df, "user_id", "event_id", "signal", "idle", step, shown).select("user_id", F.array_join("shown", "").alias("path"))


CELLS = "SELECT DISTINCT floor(l_quantity)::BIGINT AS i, floor(l_extendedprice / 2000)::BIGINT AS j FROM lineitem"


def cells(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.select(F.floor("l_quantity").cast("long").alias("i"), F.floor(F.col("l_extendedprice") / 2000).cast("long").alias("j")).distinct()


@query(f"SELECT DISTINCT (i + x.range - 2)::BIGINT AS i, (j + y.range - 2)::BIGINT AS j FROM ({CELLS}), range(5) x, range(5) y")
def extended_domain(spark, sf_dir):
    return grid.extend(cells(spark, sf_dir), 2)


@query(f"SELECT count(*)::BIGINT AS active, max(greatest(abs(i - 25), abs(j - 20)))::BIGINT AS speed FROM ({CELLS}) WHERE (i * 7 + j) % 5 < 3")
def marked_cells(spark, sf_dir):
    df = cells(spark, sf_dir).withColumns({"v": (F.col("i") * 7 + F.col("j")) % 5, "vx": F.col("i") - 25, "vy": F.col("j") - 20})
    live = grid.refit(grid.mark(df, F.col("v") < 3))
    return live.agg(F.count(F.lit(1)).alias("active"), F.max(grid.speed(["vx", "vy"])).alias("speed"))
