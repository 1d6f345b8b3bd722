"""Every registered query of the engine against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from latticework.plans import adaptive, arrays, collections, collisions, contact, derivatives, functions, linear, mathematics, meshes, physics, sampling, space, trees  # noqa: F401
from latticework.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted(plain(tuple(r)) for r in df.select(*columns).collect()) == sorted(plain(tuple(r[k] for k in place)) for r in want.fetchall())
