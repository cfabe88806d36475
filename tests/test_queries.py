"""Every query with SQL against DuckDB on the smallest tables; the driver does the same on larger ones."""

import glob
import os

import duckdb
import pytest

from aliasflow import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, duck, name):
    df = queries.ALL[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert rows and got == rows
