"""Queries against their SQL on tables that hold what the supplied ones do not."""

import duckdb
import pyarrow as pa

from aliasflow import queries
from aliasflow.operators import naming
from aliasflow.plans import parse


def both(spark, folder, name, table, rows, columns):
    """Sorted rows of a query and of its SQL, over one table."""
    con = duckdb.connect()
    con.execute(f"create table {table} ({columns})")
    con.executemany(f"insert into {table} values ({', '.join('?' * len(rows[0]))})", rows)
    con.execute(f"copy {table} to '{folder}/{table}.parquet' (format parquet)")
    df = queries.ALL[name](spark, str(folder))
    want = con.sql(queries.SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    return sorted(map(tuple, df.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_fragments_with_fractions_and_without_ends(spark, tmp_path):
    rows = [(1, 5, 0.5), (1, 7, 1.0), (2, 5, 0.9), (2, 8, 1.0), (3, 5, None), (3, 5, 1.0), (3, 6, 4.0), (4, None, 2.0), (4, None, 2.0), (4, 9, 2.5), (5, 3, 2.0), (5, 3, 2.0), (None, 1, 1.0)]
    got, want = both(spark, tmp_path, "fragment_merge", "lineitem", rows, "l_orderkey bigint, l_partkey bigint, l_quantity double")
    assert got == want
    assert (2, 5, 11) in got and (3, 5, 18) in got and (5, 3, 9) in got


def test_plans_of_one_part_are_dealt_out_and_recognised_once(spark):
    texts = ["Seq Scan on t  (cost=0.00..1.00 rows=1 width=4)", "-> Limit: 3", "nothing", None, " QUERY PLAN\n----------------------\n Seq Scan on t  (cost=0.00..1.00 rows=1 width=4)\n(1 row)\n"]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    done = parse.read_plans(some)
    assert done.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "Filter" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: (r.format, r.status, r.form) for r in done.collect()} == {0: ("text", "read", None), 1: ("mysql-tree", "refused", "MYSQL_TREE"), 2: (None, "unreadable", None), 3: (None, "unreadable", None), 4: (None, "read", None)}
    assert {r.text.strip() for r in parse.anonymize_plans(some).select("text").collect()} == {"Seq Scan on table1  (cost=0.00..1.00 rows=1 width=4)", "QUERY PLAN\n----------------------\n Seq Scan on table1  (cost=0.00..1.00 rows=1 width=4)\n(1 row)"}


def test_histories_are_folded_by_part_and_keep_rows_without_an_invocation(spark):
    rows = [(p, s, 0, f"k{p}{s}", "Type", "x", True) for p in ("a", "b", None) for s in (2, 1, None)]
    some = spark.createDataFrame(rows, "project_id string, seq long, start int, key string, namespace string, original string, qualified boolean").coalesce(1)
    named = naming.name_symbols(some)
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    assert {(r.project_id, r.seq, r.placeholder) for r in named.collect()} == {(p, s, w) for p in ("a", "b", None) for s, w in ((1, "Type1"), (2, "Type2"), (None, "Type3"))}


def test_heads_are_folded_without_rows_of_names_and_missing_columns_do_not_travel(spark, tmp_path):
    rows = [(k, None if k % 11 == 0 else k % 4) for k in range(40)] + [(None, 1), (None, 1), (None, None)]
    got, want = both(spark, tmp_path, "recorded_stems", "orders", rows[:40], "o_orderkey bigint, o_custkey bigint")
    assert got == want and (None, 5, ["getPet", "pet"]) in got
    plan = queries.ALL["recorded_stems"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Aggregate", "siblings", "reserved", "literal", "getF"))
    plan = naming.name_symbols(spark.createDataFrame(rows, "seq long, project_id string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "siblings#" not in plan.split("MapInArrow")[1].split("\n", 1)[1]


def test_heads_of_histories_equal_the_heads_of_their_rows(spark):
    sibling = [("s1", "setTotal", "set", "f1", True), ("s2", "isTotal", "is", "f2", None)]
    symbols = [
        ("m1", "method", "getTotal", True, "f1", "total", None, "get", None, "sum", None, sibling, ["getSum2", "Type1"]),
        ("f2", "field", "count", False, None, None, None, None, "cnt", None, False, None, ["Type2"]),
        ("m2", "method", "getCount", True, "f2", None, False, "get", None, None, None, [], None),
        ("", "str", "x", None, None, None, None, None, None, None, True, None, []),
        ("c", "Type", "C", True, None, None, True, None, "", None, None, sibling[:1], ["Type5", "cnt3"]),
        ("m3", "method", "isM1", True, "m1", "m", True, "is", None, None, None, None, ["isGetSum1"]),
    ]
    of = [(p, s, i) for p in ("a", "b", "ü", "", None) for s in (3, 1, None, 2) for i in range(6) if (len(p or "") + (s or 5) * i) % 3]
    rows = [(p, s, None if i == 4 else i, *symbols[(i + (s or 0)) % 6]) for p, s, i in of]
    schema = ", ".join(f"{k} {t}" for k, t in naming.EVIDENCE.items())
    some = spark.createDataFrame(rows, schema)
    got, want = naming.history_heads(some), naming.delta_heads(naming.name_symbols(some))
    assert got.dtypes == want.dtypes and len(got.collect()) == 5
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    assert any(r.stems for r in got.collect())
    assert naming.history_heads(some.limit(0)).collect() == []


def test_columns_become_the_values_that_to_pylist_makes():
    for column in (pa.array(["a", None, "", "ü\0"]), pa.array([True, None]), pa.array([False]), pa.array([], pa.string()), pa.array([None], pa.string()), pa.array([None], pa.bool_()), pa.array([1, None]), pa.array([["a"], None]), pa.array(["x", None, "z"]).slice(1)):
        assert list(map(repr, naming._values(column))) == list(map(repr, column.to_pylist()))
