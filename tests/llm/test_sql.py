"""The queries of the training-data operators against DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__
from strataloom.llm.queries import ORACLES, QUERIES
from tests.test_oracle import SF, duck, plain  # noqa: F401


def test_oracles_are_sql():
    sql = __spark_entry__.oracle_sql()
    assert all(isinstance(x, str) for x in sql.values()) and sql.keys() <= __spark_entry__.queries().keys() and ORACLES.keys() <= sql.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ran = duck.execute(ORACLES[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    rows = lambda at, found: sorted((tuple(plain(r[at(c)]) for c in cols) for r in found), key=repr)
    assert rows(lambda c: c, df.collect()) == rows(names.index, ran.fetchall())
