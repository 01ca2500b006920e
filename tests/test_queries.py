"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="session")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([[plain(r[i]) for i in order] for r in rows])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, sf, name):
    df = QUERIES[name](spark, sf)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    wanted = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert got == rows_of(wanted.fetchall(), wanted.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(5).collect() is not None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
