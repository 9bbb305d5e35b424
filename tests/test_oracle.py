"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidegauge import oracle, queries

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: [(v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, duck, name):
    got = queries.queries()[name](spark, small)
    columns = sorted(got.columns)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = [[dict(zip(names, r))[c] for c in columns] for r in rel.fetchall()]
    mine = ordered([[r[c] for c in columns] for r in got.collect()])
    assert len(mine) == len(want)
    for a, b in zip(mine, ordered(want)):
        assert all(x == pytest.approx(y, abs=2e-5) if isinstance(x, float) or isinstance(y, float) else x == y for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
