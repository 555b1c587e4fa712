"""Each registered query with SQL, on the smallest tables, against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
ORACLE = __spark_entry__.oracle_sql()


def cells(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("NULL" if r[i] is None or r[i] != r[i] else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = db.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert cells(df.columns, df.collect()) == cells(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0 and __spark_entry__.queries()
