"""Every query with SQL gives the rows DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = ["events", "orders", "lineitem", "part", "documents", "pages", "conversations", "benchmark"]
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = driver.queries()
ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return (0, "")
    if isinstance(value, str):
        return (2, value)
    return (1, float(value))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def same(a, b):
    return a[0] == b[0] and (a[1] == b[1] or (a[0] == 1 and math.isclose(a[1], b[1], rel_tol=1e-9, abs_tol=2e-6)))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF_DIR)
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    left, right = table(got.columns, got.collect()), table(columns, want.fetchall())
    assert len(left) == len(right)
    assert len(left) > 0
    for a, b in zip(left, right):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
