"""Every query with SQL against DuckDB on the smallest tables: columns, row counts and values."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from noticeflow.plans.catalog import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, datetime.date) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p).split('.')[0]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    left = sorted((tuple(map(_plain, r)) for r in got.select(*columns).collect()), key=repr)
    right = sorted((tuple(map(_plain, r)) for r in want.fetchall()), key=repr)
    assert len(left) == len(right)
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
