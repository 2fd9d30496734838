"""Every registered query with SQL gives the same rows in Spark and DuckDB, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("QUIRE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (int, float)):
        return round(float(v), 6) if math.isfinite(v) else str(v)
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {t} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(entry.catalogue.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in res.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(entry.catalogue.queries().keys() - entry.catalogue.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    df = entry.catalogue.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
