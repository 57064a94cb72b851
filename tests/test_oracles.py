"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from trellis import more_queries as more
from trellis import queries as q

QUERIES = q.queries() | more.queries()
SQL = q.oracle_sql() | more.oracle_sql()

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if (sql := SQL.get(name)) is None:
        return
    found = db.sql(sql)
    assert sorted(found.columns) == columns
    want = sorted((tuple(dict(zip(found.columns, r, strict=True))[c] for c in columns) for r in found.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
