"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import math

import duckdb
import pytest

from captrail.plans import load_all, registry
from captrail.sources.tables import BASE

load_all()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    got = df.collect()
    if name not in registry.ORACLES:
        assert df.columns
        return
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [list(want.columns).index(c) for c in columns]
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in got)
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert ours == theirs


def test_no_oracle_without_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
