from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from symloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6) + 0.0
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = sorted((tuple(map(plain, r)) for r in df.collect()), key=str)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert catalog.flagship(spark, SF).columns == ["depth", "node", "name", "kind"]
