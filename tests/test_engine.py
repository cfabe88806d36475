"""Goldens and properties of plans, numbering, reversal, state and traces."""

from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aliasflow.functions import text as X
from aliasflow.operators import allocation, formats, naming, policy, reports, reversal, state, traces
from aliasflow.plans import documents, oracle_grid, postgres_text, sqlserver_text, structured
from aliasflow.plans import parse as plan_rows
from aliasflow.plans.expressions import expression, parameters
from aliasflow.streaming import ledger

PLAN = """Hash Join  (cost=31.40..88.02 rows=310 width=52) (actual time=0.610..1.902 rows=287 loops=1)
  Hash Cond: (p.owner = k.id)
  ->  Seq Scan on zoo.pets p  (cost=0.00..41.10 rows=1110 width=24)
        Filter: (lower(kind) <> 'cat''s'::text)
        Rows Removed by Filter: 12
  ->  Hash  (cost=20.00..20.00 rows=900 width=28)
        ->  Index Only Scan using keepers_by_id on keepers k  (cost=0.15..20.00 rows=900 width=28)
              Index Cond: ((id > 7) AND (id < 950))
Execution Time: 2.114 ms"""
GOLDEN = """Hash Join  (cost=31.40..88.02 rows=310 width=52) (actual time=0.610..1.902 rows=287 loops=1)
  Hash Cond: (table1.col2 = table3.col4)
  ->  Seq Scan on schema5.table6 table1  (cost=0.00..41.10 rows=1110 width=24)
        Filter: (lower(col7) <> 'str8'::text)
        Rows Removed by Filter: 12
  ->  Hash  (cost=20.00..20.00 rows=900 width=28)
        ->  Index Only Scan using idx9 on table10 table3  (cost=0.15..20.00 rows=900 width=28)
              Index Cond: ((col4 > 7) AND (col4 < 950))
Execution Time: 2.114 ms"""


def test_text_plan_golden(spark):
    rows = [
        (1, PLAN), (2, 'Seq Scan on "Mixed Case"  (cost=0.00..1.00 rows=1 width=4)'), (3, "Seq Scan on t  (cost=0..1)\n  Bogus: 1"), (4, None), (5, "Seq Scan on t  (cost=0..1)\nSettings: x = 'y'"),
        (6, "hello"), (7, "-> Limit"), (8, '<ShowPlanXML Version="1.5">'), (9, "Seq Scan on t  (cost=0..1)\n  Filter: (table1 = 'col2')"),
    ]
    subjects = spark.createDataFrame(rows, "doc_id long, text string").withColumn("status", F.lit("mine"))
    got = {r.doc_id: r.text for r in plan_rows.anonymize_plans(subjects).collect()}
    assert got == {1: GOLDEN, 2: 'Seq Scan on "table1"  (cost=0.00..1.00 rows=1 width=4)', 9: "Seq Scan on table1  (cost=0..1)\n  Filter: (col2 = 'str3')"}
    status = {r.doc_id: (r.status, r.form, r.recourse) for r in plan_rows.parse_plans(subjects).where("status != 'read'").collect()}
    assert status == {3: ("unreadable", None, None), 4: ("unreadable", None, None), 5: ("refused", "POSTGRES_TEXT_RAW_NAME_ROW", "POSTGRES_FORMAT_JSON"), 6: ("unreadable", None, None), 7: ("refused", "MYSQL_TREE", "MYSQL_FORMAT_JSON"), 8: ("unreadable", None, None)}
    names = [tuple(r) for r in plan_rows.plan_names(subjects).where("doc_id = 9").orderBy("ordinal").collect()]
    assert [n[1:5] for n in names] == [(0, "t", "table1", "TABLE"), (1, "table1", "col2", "COLUMN"), (2, "col2", "str3", "LITERAL")]
    assert {r.doc_id: (r.replaced, r.preserved) for r in plan_rows.plan_counts(subjects).collect()}[1] == (9, 3)


def said(spans, text):
    return [(s.disposition, s.role, text[s.name_start : s.name_end]) for s in spans]


def test_expressions():
    text = "(a.b = c AND lower(d) = 'it''s' AND e::timestamp with time zone < 5kB)"
    assert said(expression(text, 0, len(text), {"a"}), text) == [
        ("anonymize", "TABLE", "a"), ("anonymize", "COLUMN", "b"), ("anonymize", "COLUMN", "c"), ("preserve", None, "AND"), ("preserve", None, "lower"), ("anonymize", "COLUMN", "d"),
        ("mask", None, "it''s"), ("preserve", None, "AND"), ("anonymize", "COLUMN", "e"), ("preserve", None, "timestamp with time zone"),
    ]
    assert said(expression("a = 'open", 0, 9, set()), "a = 'open") == [("mask", None, "a = 'open")]
    text = "$1 = 'x', $2 = 5, $3 = NULL, $4 = f(1, 2)"
    assert said(parameters(text, 0, len(text), set()), text) == [("mask", None, "x"), ("preserve", None, "NULL"), ("mask", None, "f(1, 2)")]
    assert [s.unscannable for s in parameters("$1 'x'", 0, 6, set())] == [True]


def test_declared_names_and_subplans():
    text = "CTE Scan on w  (cost=0..1)\n  Filter: (w.x > (SubPlan 1))\n  CTE w\n    ->  Result  (cost=0..1)\n  SubPlan 1\n    ->  Result  (cost=0..1)"
    keys = {text[s.start : s.end]: s.key for s in postgres_text.parse(text) if s.key}
    assert keys == {"w": "plan-declared:TABLE:w", "x": "plan:COLUMN:x"}


def test_fast_path_equals_fold_where_nothing_burns(spark):
    rows = [(d, f"k{(d * 7 + i * 5) % 6}", i, "col", "o") for d in range(20) for i in range(12)]
    occurrences = spark.createDataFrame(rows, "doc_id long, key string, start int, namespace string, original string")
    none = spark.createDataFrame([], "doc_id long, word string")
    fast, slow = (sorted(map(tuple, f.select("doc_id", "key", "placeholder").collect())) for f in (allocation.number_fast(occurrences), allocation.number_fold(occurrences, none)))
    assert fast == slow
    taken = spark.createDataFrame([(3, "col1"), (3, "col3"), (4, "column1")], "doc_id long, word string")
    both = {(r.doc_id, r.number) for r in allocation.number(occurrences, taken, ["col"]).collect()}
    assert {n for d, n in both if d == 3} == {2, 4, 5, 6, 7, 8} and {n for d, n in both if d == 4} == set(range(1, 7))


@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=2), st.sampled_from(["col", "Type"])), max_size=20, unique_by=lambda x: x[0]), st.sets(st.sampled_from([f"{n}{i}" for n in ("col", "Type") for i in range(1, 9)])))
@settings(deadline=None)
def test_no_placeholder_is_taken_or_given_twice(keys, taken):
    out = list(allocation.fold(keys, taken, 1))
    words = [w for *_, w in out]
    assert len(set(words)) == len(words) == len(keys) and not set(words) & taken
    numbers = [n for _, n, _ in out]
    assert numbers == sorted(set(numbers))


def test_splice_and_reserved_words(spark):
    df = spark.createDataFrame([("a😀b foo bar", [(3, 3, "X"), (5, 8, "yy"), (0, 1, "")])], "text string, edits array<struct<start:int,end:int,text:string>>")
    r = df.select(X.splice(F.col("text"), F.col("edits")).alias("s"), X.reserved_words(F.col("text"), F.array(F.struct(F.lit(4).alias("start"), F.lit(8).alias("end")))).alias("w")).first()
    assert r.s == "😀bX fyybar" and r.w == ["a", "b", "bar"]


def test_reversal_reasons_and_verdicts(spark):
    replies = spark.createDataFrame([("p", 1, "Type1 ${Type2} getField3 Type9 Type99 setfield3 Word7"), ("p", 2, "nothing here"), ("q", 3, "Type1"), ("p", 4, None)], "project_id string, doc_id long, text string")
    runs = spark.createDataFrame([("p", 1, "Type1", "Old"), ("p", 2, "Type1", "New Type2"), ("p", 2, "field3", "total")], "project_id string, seq long, placeholder string, original string")
    durable = spark.createDataFrame([("p", "Type1", "Ledger", "a"), ("p", "Type2", "Invoice", "b"), ("p", "Type9", " ", "c")], "project_id string, placeholder string, original string, key string")
    heads = spark.createDataFrame([("p", 50, ["Word"])], "project_id string, next_number int, stems array<string>")
    got = {r.doc_id: r for r in reversal.paste_verdict(reversal.deanonymize(replies, runs, durable, heads)).collect()}
    assert got[1].text == "New Type2 ${Invoice} getField3 Type9 Type99 setfield3 Word7" and got[1].restored == ["Type1", "Type2"]
    assert [tuple(u) for u in got[1].unrestored] == [("getField3", "UNSENT_SPELLING"), ("Type9", "EVICTED"), ("Type99", "FOREIGN"), ("Word7", "EVICTED")]
    assert [tuple(u) for u in got[3].unrestored] == [("Type1", "FOREIGN")] and got[2].verdict == got[4].verdict == "none" and got[1].verdict == "refused" and got[4].text is None


def test_history_window_keeps_the_newest(spark):
    rows = [("p", i, datetime(2024, 1, 1) + timedelta(hours=12 * i)) for i in range(120)]
    runs = spark.createDataFrame(rows, "project_id string, seq long, at timestamp")
    now = F.lit("2024-02-29 12:00:00").cast("timestamp")
    assert sorted(r.seq for r in state.bounded(runs, now).collect()) == list(range(70, 120))
    assert sorted(r.seq for r in state.bounded(runs, now + F.expr("INTERVAL 20 DAYS")).collect()) == list(range(99, 120))


def test_ledger_is_append_only_and_keeps_its_counter(spark):
    old = spark.createDataFrame([("p", "a", "Type1", "A")], "project_id string, key string, placeholder string, original string")
    new = spark.createDataFrame([("p", "a", "Type7", "X"), ("p", "b", "Type8", "B")], old.schema)
    assert sorted(map(tuple, state.commit(old, new).collect())) == [("p", "a", "Type1", "A"), ("p", "b", "Type8", "B")]
    heads = spark.createDataFrame([("p", 5, ["x"])], "project_id string, next_number int, stems array<string>")
    after = state.commit_heads(heads, spark.createDataFrame([("p", 9, ["y", "x"])], heads.schema))
    assert after.collect() == [("p", 9, ["x", "y"])] and state.clear(after, F.lit(True)).collect() == [("p", 9, [])]
    assert state.is_stale(after, heads).collect() == [("p", True)]


def test_stream_equals_batch_and_ignores_replays(spark, tmp_path):
    rows = []
    for i in range(60):
        key = (i * 5) % 7
        field = (f"f{key % 3}", f"total{key % 3}", "get", [(f"set{key % 3}", f"setTotal{key % 3}", "set", f"f{key % 3}", True)]) if key % 2 else (None, None, None, [])
        rows.append((f"p{i % 3}", i // 6, i % 6, f"k{key}", "method", f"o{key}", i % 2 == 0, *field, ["method3", "getField2"] if i % 4 == 0 else []))
    schema = f"project_id string, seq long, start int, key string, namespace string, original string, qualified boolean, field_key string, field_name string, prefix string, siblings array<{naming.SIBLING}>, reserved array<string>"
    frame = spark.createDataFrame(rows, schema)
    said = lambda df: sorted(map(str, df.drop("stems").collect()))
    want = said(naming.name_symbols(frame))
    for part in ("seq < 4", "seq between 2 and 7", "seq > 5"):  # with replays
        frame.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    had = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ledger.PROVIDER)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = ledger.stream(source).writeStream.format("memory").queryName("ledger_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", had)
    assert said(spark.table("ledger_out")) == want
    words = spark.table("ledger_out").where("fresh and not sibling").groupBy("project_id", "placeholder").count().where("count > 1")
    assert words.count() == 0


def test_traces(spark):
    good = 'Exception in thread "main" com.acme.A: boom: x\n\tat app//com.acme.A$B.go(A.java:3)\n\tat k.C.invokeSuspend(Unknown Source)\n\tSuppressed: x.Y\n\t... 2 more\nCaused by: z.Z:\n  at z.Z.<clinit>(Native Method)\n'
    rows = [(1, good), (2, "hello\nworld"), (3, "com.acme.A\nat com.acme.A.go(A.java)"), (4, "Coroutines dump 2024"), (5, None), (6, good.replace("\n", "\r\n"))]
    got = {r.doc_id: r for r in traces.parse_traces(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].status for i in range(1, 7)] == ["read", "not_a_trace", "not_a_trace", "coroutine_dump", "not_a_trace", "read"]
    assert got[1].exceptions == ["com.acme.A", "x.Y", "z.Z"] and got[1].texts == ["main", "boom: x"]
    assert [tuple(f) for f in got[1].frames] == [("com.acme.A$B", "go", "A.java"), ("k.C", None, None), ("z.Z", None, None)]
    assert "app//" not in got[1].stripped and got[6].exceptions == got[1].exceptions
    files = spark.createDataFrame([("f", "a\n---\nb\n-----\n\n")], "name string, text string")
    assert [(r.part, r.text) for r in traces.split_traces(files).collect()] == [(0, "a\n"), (1, "b\n")]


def test_policy_and_reports(spark):
    lit = spark.range(1).select(
        policy.literal_coverage(F.lit("STRING"), F.lit(0), F.lit(7), F.lit("foo.bar"), F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit(True).alias("resolved")), F.struct(F.lit(4).alias("start"), F.lit(7).alias("end"), F.lit(True).alias("resolved")))).alias("a"),
        policy.literal_coverage(F.lit("STRING"), F.lit(0), F.lit(7), F.lit("foo.bar"), F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit(True).alias("resolved")))).alias("b"),
        policy.literal_coverage(F.lit("CHAR"), F.lit(0), F.lit(1), F.lit("x"), F.array().cast("array<struct<start:int,end:int,resolved:boolean>>")).alias("c"),
        policy.namespace(F.lit("UNRESOLVED"), F.lit("FIELD")).alias("d"),
        policy.namespace(F.lit("JDK"), F.lit("INDEX")).alias("e"),
    ).first()
    assert tuple(lit) == ("splice", "str", "preserve", "Unknown", "idx")
    captures = spark.createDataFrame([("text", "read", None), ("refusal-mysql-tree", "refused", "MYSQL_TREE"), ("refusal-mariadb", "refused", "MYSQL_TREE"), ("json", "unreadable", None), ("refusal-mariadb", "read", None)], "label string, status string, form string")
    assert {r.verdict: r.n for r in reports.capture_verdicts(captures).collect()} == {"right": 2, "wrong_message": 1, "refused_admitted": 1, "read_refused": 1}


JSON = """[
  {
    "Plan": {
      "Node Type": "Seq Scan",
      "Relation Name": "visits",
      "Schema": "billing",
      "Alias": "v",
      "Output": ["v.id", "lower(status)"],
      "Plans": [ {"Node Type": "Result", "Actual Rows": 1} ]
    },
    "Settings": {"search_path": "billing, \\"$user\\", public", "work_mem": "4MB", "app.x": "y"}
  }
]"""
YAML = """- Plan:
    Node Type: "Seq Scan"
    Relation Name: "visits"
    Alias: "v"
    Output:
    Plans:
      - Node Type: "Result"
        Filter: "(v.id = 5)"
      - Node Type: "Result"
  Planning Time: 0.1
- Plan:
    Node Type: "Result"
"""
XML = """<explain xmlns="http://www.postgresql.org/2009/explain">
  <Query><Plan><Node-Type>Seq Scan</Node-Type><Relation-Name>visits</Relation-Name><Output><Item>id</Item><Item>status</Item></Output></Plan></Query>
</explain>"""


def test_structured_plans():
    spoken = lambda text, kind: [(s.disposition[0], text[s.name_start : s.name_end]) for s in structured.parse(text, kind) if s.disposition != "preserve"]
    assert spoken(JSON, "json") == [("a", "visits"), ("a", "billing"), ("a", "v"), ("a", "v"), ("a", "id"), ("a", "status"), ("a", "billing"), ("a", "public"), ("m", "app.x"), ("m", "y")]
    assert spoken(YAML, "yaml") == [("a", "visits"), ("a", "v"), ("a", "v"), ("a", "id")]
    assert spoken(XML, "xml") == [("a", "visits"), ("a", "id"), ("a", "status")]
    counts = {k: len(v) for k, v in {**structured.POSTGRES, **structured.MYSQL}.items()}
    mysql = {"mysql2": 3, "mysql2_node": 28, "mysql1": 1, "mysql1_block": 17, "mysql1_union": 4, "mysql1_table": 21, "mysql1_cost": 6}
    assert counts == {"query": 11, "buffers": 22, "plan": 119, "trigger": 6, "jit": 4, "options": 4, "timing": 5, "sort": 4, "space": 2, **mysql} and len(structured.FLAGGED) == 61
    for text in ('[{"Plan": {"Bogus": 1}}]', '[{"Plan": {}]', "[{}] x", "[1]", "{}", '[{"a" 1}]', '[{"Plan": {"Filter": {"x": 1}}}]', "[" * 5000):
        try:
            structured.parse(text, "json")
            raise AssertionError(text)
        except postgres_text.Refused:
            pass
    assert documents.read_yaml("a: 1") is None and documents.read_xml("<explain><a></b></explain>") is None and documents.read_xml("<!-- x --><explain></explain>") is None


def test_framed_plans(spark):
    framed = " QUERY PLAN\n-------------\n" + "\n".join(f" {x.ljust(60)}+" for x in JSON.split("\n")[:-1]) + "\n ]\n(1 row)\n"
    rows = " QUERY PLAN\n" + "-" * 60 + "\n" + "\n".join(f" {x}" for x in PLAN.split("\n")) + "\n(9 rows)\n"
    wrong = rows.replace("(9 rows)", "(7 rows)")
    got = {r.doc_id: r.text for r in plan_rows.anonymize_plans(spark.createDataFrame([(1, framed), (2, rows), (3, wrong)], "doc_id long, text string")).collect()}
    assert got.keys() == {1, 2} and [x.strip() for x in got[2].split("\n")[2:-2]] == [x.strip() for x in GOLDEN.split("\n")] and '"Relation Name": "table1"' in got[1]


def test_every_format_is_told_apart(spark):
    mysql = '{\n  "query_block": {\n    "select_id": 1,\n    "%s": {'
    texts = {
        "text": PLAN, "json": JSON, "yaml": YAML, "xml": XML,
        "mysql-json-v2": '{\n  "query": "x"\n}', "mysql-json-v1": mysql % "cost_info", "mariadb-json": mysql % "r_loops",
        "mysql-tree": "+----+\n| EXPLAIN |\n+----+\n| -> Limit |", "mysql-tabular": "+--+\n| Level | Code | Message |",
        "mariadb-tabular": "| id | select_type | table | type | possible_keys | key | key_len | ref | rows | Extra |",
        "sqlserver-showplan-xml": '<ShowPlanXML xmlns="x">', "sqlserver-showplan-text": "StmtText\n  |--Sort(x)",
        "sqlserver-showplan-all": "\t".join(formats.SHOWPLAN_ALL.split()), "sqlserver-statistics-profile": "\t".join(("Rows Executes " + formats.SHOWPLAN_ALL).split()),
        "oracle-grid-text": "------------\n| Id  | Operation | Name | Rows |", "oracle-sql-monitor-xml": "<report db_version='1'>",
    }
    assert set(texts) == {n for n, *_ in formats.FORMATS} and formats.catalogue(spark).count() == 16
    frame = spark.createDataFrame([*texts.items(), ("none", "hello"), ("both", mysql % "table"), ("null", None)], "name string, text string")
    got = {r["name"]: (r["format"], r["status"]) for r in formats.readings(frame).collect()}
    assert {k: v[0] for k, v in got.items() if k in texts} == {k: k for k in texts}
    assert all(got[n][1] == ("refused" if s == "refused" else "recognised") for n, _, s, _ in formats.FORMATS)
    assert got["none"] == got["both"] == got["null"] == (None, "unreadable")


def test_mysql_documents():
    spoken = lambda text, kind: [(s.disposition[0], text[s.name_start : s.name_end]) for s in structured.parse(text, kind) if s.disposition != "preserve"]
    two = """{
  "query": "select 1",
  "inputs": [{"operation": "Index lookup on visits using by_owner (owner_id = 7)", "table_name": "visits", "schema_name": "shop", "index_name": "by_owner", "lookup_condition": "owner_id = 7", "covering": false,
    "inputs": [{"operation": "Sort: shop.visits.id", "sort_key": "shop.visits.id", "estimated_rows": 1.0}]}]
}"""
    assert spoken(two, "mysql-json-v2") == [
        ("m", "select 1"), ("a", "visits"), ("a", "by_owner"), ("m", "owner_id = 7"), ("a", "visits"), ("a", "shop"), ("a", "by_owner"), ("m", "owner_id = 7"),
        ("a", "shop"), ("a", "visits"), ("a", "id"), ("a", "shop"), ("a", "visits"), ("a", "id"),
    ]
    one = """{
  "query_block": {
    "select_id": 1,
    "cost_info": {"query_cost": "1.00"},
    "nested_loop": [{"table": {"table_name": "visits", "access_type": "ref", "possible_keys": ["by_owner"], "key": "by_owner", "key_length": "4", "ref": ["shop.i.id"], "used_columns": ["id", "status"], "attached_condition": "(x = 1)", "filtered": "100.00"}}]
  }
}"""
    assert spoken(one, "mysql-json-v1") == [("a", "visits"), ("a", "by_owner"), ("a", "by_owner"), ("m", "shop.i.id"), ("a", "id"), ("a", "status"), ("m", "(x = 1)")]
    for text, kind in ((two.replace("Sort: shop", "Sort: shoq"), "mysql-json-v2"), (one.replace('"ref",', '"odd",'), "mysql-json-v1"), (one.replace('"id", "st', '"a.id", "st'), "mysql-json-v1")):
        try:
            structured.parse(text, kind)
            raise AssertionError(text)
        except postgres_text.Refused:
            pass


def test_sqlserver_rows():
    text = "StmtText\n  |--Nested Loops(Inner Join, OUTER REFERENCES:([i].[visit_id]))\n       |--Index Seek(OBJECT:([shop].[dbo].[Visits].[IX_Visits] AS [i]), SEEK:([i].[a]]b]=(5) AND [x]='it''s') ORDERED)\n"
    got = [(s.disposition[0], s.role, s.key, text[s.name_start : s.name_end]) for s in sqlserver_text.parse(text)]
    assert got == [
        ("a", "TABLE", "plan-declared:TABLE:i", "i"), ("a", "COLUMN", "plan:COLUMN:visit_id", "visit_id"),
        ("a", "SCHEMA", "plan:SCHEMA:shop", "shop"), ("a", "SCHEMA", "plan:SCHEMA:dbo", "dbo"), ("a", "TABLE", "plan:TABLE:Visits", "Visits"), ("a", "INDEX", "plan:INDEX:IX_Visits", "IX_Visits"),
        ("a", "TABLE", "plan-declared:TABLE:i", "i"), ("a", "TABLE", "plan-declared:TABLE:i", "i"), ("a", "COLUMN", "plan:COLUMN:a]b", "a]]b"), ("a", "COLUMN", "plan:COLUMN:x", "x"), ("m", None, "plan-mask:it''s", "it''s"),
    ]
    for bad in ("|--Sort([a)", "|--Sort([])", "|--Sort('x)", "|--Remote Query(x)", "|--Sort(x)\nodd", "StmtText", "|--Scan(OBJECT:([a].[b].[c].[d].[e]))", "|--Scan(OBJECT:([a] AS b))"):
        try:
            sqlserver_text.parse(bad)
            raise AssertionError(bad)
        except postgres_text.Refused as e:
            assert (e.form is not None) == ("Remote" in bad)


GRID = """Plan hash value: 123456
------------------------------------------------
| Id  | Operation         | Name      | Rows |
------------------------------------------------
|   0 | SELECT STATEMENT  |           |      |
|*  1 |  TABLE ACCESS FULL| VISITS    |    5 |
|*  2 |   INDEX RANGE SCAN| IX_VISITS |    5 |
------------------------------------------------

Predicate Information (identified by operation id):
---------------------------------------------------
   1 - filter("V"."STATUS"='open' AND UPPER("X")=:city)
   2 - access("V"."ID" IS NOT NULL)
"""


def test_oracle_grid():
    got = [(s.disposition[0], GRID[s.name_start : s.name_end]) for s in oracle_grid.parse(GRID) if s.disposition != "preserve"]
    assert got == [("m", "123456"), ("a", "VISITS"), ("a", "IX_VISITS"), ("a", "V"), ("a", "STATUS"), ("m", "open"), ("a", "X"), ("a", "city"), ("a", "V"), ("a", "ID")]
    assert [s.role for s in oracle_grid.parse(GRID) if s.key and s.key.endswith("VISITS")] == ["TABLE", "INDEX"]
    outline = GRID.replace("Predicate Inf", "Outline Data\n-----\n  /*+\n      FULL(@\"SEL$1\" \"V\"@\"SEL$1\")\n  */\nPredicate Inf")
    assert ("p", "FULL") in [(s.disposition[0], outline[s.name_start : s.name_end]) for s in oracle_grid.parse(outline)]
    for bad in (GRID.replace("|    5 |", "|    5 | 7 |", 1), GRID + "note", GRID.replace("| Rows", "| Odd "), GRID + "Peeked Binds (x):", "Plan hash value: 1", GRID.replace("|   0 | SELECT STATEMENT  |           |      |", "| Id  | Operation         | Name      | Rows |")):
        try:
            oracle_grid.parse(bad)
            raise AssertionError(bad)
        except postgres_text.Refused:
            pass


SHOWPLAN = """<ShowPlanXML xmlns="http://schemas.microsoft.com/sqlserver/2004/07/showplan" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" Version="1.564" Build="16.0.1">
 <BatchSequence><Batch><Statements>
  <StmtSimple StatementText="select * from zoo.pets" StatementId="1" StatementType="SELECT" QueryHash="0x1F" RetrievedFromCache="true">
   <StatementSetOptions ANSI_NULLS="true" ARITHABORT="0"/>
   <QueryPlan CachedPlanSize="16">
    <RelOp NodeId="0" PhysicalOp="Clustered Index Seek" Parallel="false">
     <OutputList><ColumnReference Database="[farm]" Schema="[zoo]" Table="[Pets]" Alias="[p]" Column="kind"/><ColumnReference Column="Expr1003"/></OutputList>
     <IndexScan Ordered="1" ScanDirection="FORWARD">
      <Object Database="[farm]" Schema="[zoo]" Table="[Pets]" Index="[PK_Pets]" Alias="[p]" IndexKind="Clustered"/>
      <SeekPredicates><SeekPredicateNew><SeekKeys><Prefix ScanType="EQ"><RangeExpressions><ScalarOperator ScalarString="[p].[owner]=(7)"><Const ConstValue="'secret'"/></ScalarOperator></RangeExpressions></Prefix></SeekKeys></SeekPredicateNew></SeekPredicates>
     </IndexScan>
    </RelOp>
    <ParameterList><ColumnReference Column="@owner" ParameterDataType="decimal(9,2)" ParameterCompiledValue="(7)"/></ParameterList>
   </QueryPlan>
  </StmtSimple>
 </Statements></Batch></BatchSequence>
</ShowPlanXML>"""
MONITOR = """<report db_version="19.0.0.0">
 <report_parameters sql_id="7abc"><type>ACTIVE</type></report_parameters>
 <sql_monitor_report version="4.0" status="DONE (ALL ROWS)" user="KEEPER">
  <sql_fulltext><![CDATA[select name from pets where owner = :b1]]></sql_fulltext>
  <binds><bind name=":B1" pos="1" dty="1" dtystr="VARCHAR2(128 CHAR)" maxlen="128" len="4"> Ada </bind><bind name=":B2" pos="2" dty="2" dtystr="NUMBER">17</bind><bind dty="12" dtystr="POINT"/></binds>
  <stats type="monitor"><stat name="elapsed_time">31</stat></stats>
  <plan><operation id="1" name="TABLE ACCESS" options="FULL" depth="1"><object type="TABLE"><owner>ZOO</owner><name>PETS</name><alias>P</alias></object></operation>
   <operation id="2" name="INDEX"><object type="INDEX"><owner>ZOO</owner><name>PETS_IX</name></object></operation></plan>
 </sql_monitor_report>
</report>"""


def test_attributed_documents(spark):
    counts = {k: len(v) for k, v in structured.SQLSERVER.items()}
    assert len(counts) == 45 and sum(counts.values()) == 221 and counts["rel_op"] == 26 and counts["statement"] == 17
    assert {k: len(v) for k, v in structured.ORACLE.items()} == {"report": 4, "report_parameters": 3, "monitor": 14, "binds": 1, "bind": 8, "stats": 2, "stat": 2, "operations": 1, "operation_row": 9, "operation_object": 4}
    got = {r.doc_id: r.anonymized for r in plan_rows.read_plans(spark.createDataFrame([(1, SHOWPLAN), (2, MONITOR)], "doc_id long, text string")).collect()}
    want = SHOWPLAN.replace("select * from zoo.pets", "str1").replace("0x1F", "str2").replace("[farm]", "[schema3]").replace("[zoo]", "[schema4]").replace("[Pets]", "[table5]").replace("[p]", "[table6]")
    want = want.replace('"kind"', '"col7"').replace("Expr1003", "str8").replace("[PK_Pets]", "[idx9]").replace("[owner]", "[col10]").replace("secret", "str11").replace("@owner", "str12")
    assert got[1] == want
    report = MONITOR.replace("7abc", "str1").replace("KEEPER", "str2").replace("select name from pets where owner = :b1", "str3").replace('":B1"', '"str4"').replace("(128 CHAR)", "").replace(' maxlen="128" len="4"', "").replace("> Ada <", ">str5<")
    report = report.replace('":B2"', '"str6"').replace("POINT", "str7").replace("ZOO", "schema8").replace("<name>PETS<", "<name>table9<").replace("<alias>P<", "<alias>table10<").replace("PETS_IX", "idx11")
    assert got[2] == report
    for text, kind in (
        (SHOWPLAN.replace("IndexKind", "IndexKynd"), "sqlserver-showplan-xml"), (SHOWPLAN.replace('"[p]" Column', '"p" Column'), "sqlserver-showplan-xml"), (SHOWPLAN.replace("<IndexScan Ordered", "text <IndexScan Ordered"), "sqlserver-showplan-xml"),
        (SHOWPLAN + "x", "sqlserver-showplan-xml"), (SHOWPLAN.replace("Build=", "Build"), "sqlserver-showplan-xml"), ("<ShowPlanXML/>", "sqlserver-showplan-xml"), (MONITOR.replace("<stats ", "<state "), "oracle-sql-monitor-xml"), (MONITOR.replace("</report>", ""), "oracle-sql-monitor-xml"),
    ):
        try:
            structured.parse(text, kind)
            raise AssertionError(text)
        except postgres_text.Refused:
            pass


def test_outline_hints():
    def said_of(text):
        return [(s.disposition[0], text[s.name_start : s.name_end]) for s in oracle_grid.hint(text, 0, len(text))]

    assert said_of("ALL_ROWS") == [("p", "ALL_ROWS")]
    assert said_of('INDEX(@"SEL$1" "P"@"SEL$1" ("PETS"."OWNER" "PETS"."KIND"))') == [("p", "INDEX"), ("p", '"SEL$1"'), ("a", "P"), ("p", '"SEL$1"'), ("a", "PETS"), ("a", "OWNER"), ("a", "PETS"), ("a", "KIND")]
    assert said_of("DB_VERSION('19.1.0')") == [("p", "DB_VERSION"), ("p", "'19.1.0'")] and said_of("OPT_PARAM('_x' 'y')") == [("p", "OPT_PARAM"), ("m", "_x"), ("m", "y")]
    assert said_of('PQ_DISTRIBUTE(@"MINE" "P"@"MINE" HASH HASH)') == [("p", "PQ_DISTRIBUTE"), ("m", "MINE"), ("a", "P"), ("m", "MINE"), ("p", "HASH"), ("p", "HASH")]
    for bad in ("UNHEARD(x)", "FULL(P)", "FULL(@P)", "DB_VERSION('secret')", "DB_VERSION('1' '2')", 'FULL("P', 'FULL "P"', "FULL(;)"):
        assert said_of(bad) == [("m", bad)]
    assert [s.unscannable for s in oracle_grid.hint("FULL(P)", 0, 7)] == [True]
