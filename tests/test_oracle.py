"""Every query that SQL can express, against DuckDB on the smallest tables; the others must run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(tiny)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{tiny}/{f}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool | str):
        return str(v)
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    cur = duck.execute(ORACLE[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cur.description], cur.fetchall())


#: Queries that may find nothing in the smallest tables.
MAY_BE_EMPTY = {"relation_extract", "stream_breaker", "p10_found", "p10_restored"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, tiny, name):
    got = QUERIES[name](spark, tiny)
    n = got.count()
    assert len(got.columns) == len(set(got.columns)) and (n > 0 or name in MAY_BE_EMPTY)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
