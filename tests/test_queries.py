"""Every query that SQL can express, against DuckDB on the smallest tables; and the rest against plain Python."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lamella.plans import container_queries, format_queries, geometry_queries, meta_queries, pixel_queries, read_queries, store_queries, tool_queries

DATA = "/root/testdata/sf0.001"
PLANS = (container_queries, format_queries, geometry_queries, meta_queries, pixel_queries, read_queries, store_queries, tool_queries)
SQL = {k: v for p in PLANS for k, v in p.SQL.items()}
QUERIES = {k: v for p in PLANS for k, v in p.QUERIES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    plain = lambda rows: sorted((tuple(repr(float(v)) if isinstance(v, float) else repr(v) for v in r) for r in rows))
    assert plain(df.select(*columns).collect()) == plain(expected)
    assert expected


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["request_id", "dataset_id", "level"] and df.count() > 0


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
