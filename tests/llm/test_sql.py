"""The SQL of this subpackage against DuckDB on the smallest tables, and that all of it is SQL."""

import glob
import os

import duckdb
import pytest

from aliasflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def test_names():
    assert len(queries.queries()) == 10 and set(queries.oracle_sql()) <= set(queries.queries())
    assert all(isinstance(x, str) for x in queries.oracle_sql().values())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert rows and got == rows
