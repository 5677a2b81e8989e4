"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import collections
import os
from pathlib import Path

import duckdb
import pytest

import compare_sql
from quirework.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
registry.load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(compare_sql.norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(registry.ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    assert got == collections.Counter(tuple(compare_sql.norm(r[have.index(c)]) for c in cols) for r in cur.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
