"""Queries: an adaptive grid over the cells of all lines, with tiles of suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive
from .registry import Tables, query

#: Branching of the grid: leaves of 8 cells a side, nodes of 32, roots of 128; and the one that it is moved to.
BITS, OTHER = (3, 2, 2), (2, 2, 3)
BACKGROUND = -1.0
CELL = {"i": "l_orderkey % 61 - 30", "j": "floor(l_extendedprice / 2000)", "k": "l_suppkey % 53 - 20"}
TILE = {"i": "8 * (s_suppkey % 13 - 6)", "j": "8 * (s_nationkey - 9)", "k": "8 * (s_suppkey % 7 - 3)"}
PROBE = {"i": "l_partkey % 131 - 65", "j": "l_suppkey % 67 - 9", "k": "l_orderkey % 71 - 33"}
POINT = {"x": "c_custkey % 251 / 4.0 - 31", "y": "c_nationkey * 2.5 + c_custkey % 3 * 0.75", "z": "c_custkey % 113 / 2.0 - 21"}


def _cast(columns: dict[str, str], kind: str) -> str:
    return ", ".join(f"({e})::{kind} AS {c}" for c, e in columns.items())


def _node(size: int, of: str = "") -> str:
    return ", ".join(f"(floor({of}{a} / {size}.0) * {size})::BIGINT AS {a}" for a in "ijk")


VALUES = (
    f"WITH c AS (SELECT i, j, k, max(v) AS v FROM (SELECT {_cast(CELL, 'BIGINT')}, l_quantity::DOUBLE AS v FROM lineitem) GROUP BY ALL), "
    f"t AS (SELECT i, j, k, max(v) AS v FROM (SELECT {_cast(TILE, 'BIGINT')}, s_suppkey::DOUBLE AS v FROM supplier) GROUP BY ALL), "
    f"n0 AS (SELECT DISTINCT {_node(8)} FROM c), n1 AS (SELECT DISTINCT {_node(32)} FROM (SELECT i, j, k FROM n0 UNION ALL SELECT i, j, k FROM t)), n2 AS (SELECT DISTINCT {_node(128)} FROM n1)"
)


def grid(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cells = t.lineitem.select(*[F.expr(e).cast("long").alias(c) for c, e in CELL.items()], F.col("l_quantity").cast("double").alias("v"))
    tiles = t.supplier.select(*[F.expr(e).cast("long").alias(c) for c, e in TILE.items()], F.col("s_suppkey").cast("double").alias("v"))
    return adaptive.build({0: cells, 1: tiles}, BITS, BACKGROUND)


def _found(points: str) -> str:
    """Points (i, j, k, ..) with the level, activity and value of what has them, by the flat tables."""
    at = lambda name, size: " AND ".join(f"{name}.{a} = floor(p.{a} / {size}.0) * {size}" for a in "ijk")
    return (
        "SELECT p.*, CASE WHEN n0.i IS NOT NULL THEN 0 WHEN n1.i IS NOT NULL THEN 1 ELSE 2 END AS level, CASE WHEN n0.i IS NOT NULL THEN c.i IS NOT NULL ELSE t.i IS NOT NULL END AS active, "
        f"CASE WHEN n0.i IS NOT NULL THEN coalesce(c.v, {BACKGROUND}) ELSE coalesce(t.v, {BACKGROUND}) END::DOUBLE AS v "
        f"FROM ({points}) p LEFT JOIN n0 ON {at('n0', 8)} LEFT JOIN n1 ON {at('n1', 32)} LEFT JOIN t ON {at('t', 8)} LEFT JOIN c ON c.i = p.i AND c.j = p.j AND c.k = p.k"
    )


PROBES = f"SELECT DISTINCT {_cast(PROBE, 'BIGINT')} FROM lineitem"


@query(f"{VALUES} {_found(PROBES)}")
def adaptive_probe(spark, sf_dir):
    """The grid at places that all lines name: in cells, in tiles and outside."""
    points = Tables(spark, sf_dir).lineitem.select(*[F.expr(e).cast("long").alias(c) for c, e in PROBE.items()]).distinct()
    return adaptive.probe(grid(spark, sf_dir), points)


def _word(level: int, bits: int, cell: int, rows: str, out: str) -> str:
    """Bits of one level's words from the least cells of what is in them."""
    side = 1 << (bits + cell)
    place = "+".join(f"(({a} - floor({a} / {side}.0) * {side})::BIGINT // {1 << cell}) * {1 << (bits * (2 - n))}" for n, a in enumerate("ijk"))
    bit = f"(1::UBIGINT << (({place}) % 64)::UBIGINT)"
    signed = "(bit_or(b)::HUGEINT - CASE WHEN bit_or(b) >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT"
    return f"SELECT {level} AS level, i, j, k, word, {signed} AS {out} FROM (SELECT {_node(side)}, (({place}) // 64)::BIGINT AS word, {bit} AS b FROM {rows}) GROUP BY i, j, k, word"


TOPOLOGY = (
    f"{VALUES}, a AS ({_word(0, 3, 0, 'c', 'active')} UNION ALL {_word(1, 2, 3, 't', 'active')}), "
    f"h AS ({_word(1, 2, 3, 'n0', 'children')} UNION ALL {_word(2, 2, 5, 'n1', 'children')}) "
    "SELECT level, i, j, k, word, coalesce(children, 0) AS children, coalesce(active, 0) AS active FROM a FULL JOIN h USING (level, i, j, k, word)"
)


@query(TOPOLOGY)
def adaptive_topology(spark, sf_dir):
    """All words of all levels, with the bits of children and of values."""
    every = [words.select(F.lit(level).alias("level"), *adaptive.AXES, "word", "children", "active") for level, words in enumerate(grid(spark, sf_dir).levels)]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query(
    f"{VALUES}, s AS (SELECT t.* FROM t ANTI JOIN n0 USING (i, j, k)), o AS (SELECT unnest([0, 4]) AS d) "
    "SELECT 0 AS level, i, j, k, v FROM c UNION ALL SELECT 1, i + x.d, j + y.d, k + z.d, v FROM s, o x, o y, o z"
)
def adaptive_restructure(spark, sf_dir):
    """All values after the grid has gone to another branching, where a tile is eight smaller ones."""
    return adaptive.values(adaptive.restructure(grid(spark, sf_dir), OTHER))


_CORNERS = "SELECT id, (floor(x) + a.d)::BIGINT AS i, (floor(y) + b.d)::BIGINT AS j, (floor(z) + e.d)::BIGINT AS k, " + " * ".join(f"abs(1 - {d}.d - ({c} - floor({c})))" for c, d in (("x", "a"), ("y", "b"), ("z", "e"))) + " AS w FROM q, d a, d b, d e"


@query(f"{VALUES}, q AS (SELECT c_custkey AS id, {_cast(POINT, 'DOUBLE')} FROM customer), d AS (SELECT unnest([0, 1]) AS d) SELECT id, sum(w * v) AS v FROM ({_found(_CORNERS)}) GROUP BY id")
def adaptive_sample(spark, sf_dir):
    """The grid between its cells, at a place of each customer."""
    points = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("id"), *[F.expr(e).cast("double").alias(c) for c, e in POINT.items()])
    return adaptive.sample(grid(spark, sf_dir), points)
