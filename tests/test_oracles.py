"""Every query that has SQL gives what DuckDB gives on the same tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return round(float(v), 9) if isinstance(v, (float, decimal.Decimal)) else v


def rows(found):
    return sorted((tuple(plain(v) for v in r) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows(df.select(*[f"`{c}`" for c in columns]).collect()) == rows(tuple(r[i] for i in order) for r in result.fetchall())


def test_names():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns
