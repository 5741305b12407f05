"""Every query of the engine against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tracewell.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, list):
        return tuple(map(plain, v))
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, tables, name):
    got = registry.queries()[name](spark, SF)
    want = tables.sql(SQL[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    place = [want.columns.index(c) for c in names]
    rows = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in got.select(*names).collect()), key=repr) == rows
