"""Every query that SQL can express, against DuckDB on the small tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from strataloom.plans.stored import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    ran = duck.execute(ORACLES[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in ran.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).collect()


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in ORACLES.values()) and ORACLES.keys() <= QUERIES.keys()
