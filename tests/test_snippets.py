"""Snippets through data frames, leak oracles, queries in strings, and the operators around them."""

import pytest
from pyspark.sql import functions as F

from aliasflow.operators import leaks, naming, policy, reports, snippets, sql_names, state, traces

SIBLINGS = f"array<{naming.SIBLING}>"
EVIDENCE = (
    "doc_id long, kind string, start int, end int, name_start int, name_end int, language string, written string, key string, role string, origin string, declared_name string, package_name string, "
    "roots array<struct<key:string,origin:string,package:string,qualified:boolean>>, qualified boolean, remainder boolean, ticked boolean, stem string, field_key string, field_name string, field_qualified boolean, field_stem string, prefix string, "
    f"siblings {SIBLINGS}, literal_kind string, refs array<struct<start:int,end:int,resolved:boolean>>, verdict string, container_start int, container_end int, suffix string"
)
NAMES = ["doc_id", "kind", "start", "end", "name_start", "name_end", "language", "written", "key", "role", "origin", "declared_name", "package_name", "roots", "qualified", "remainder", "ticked", "stem", "field_key", "field_name", "field_qualified", "field_stem", "prefix", "siblings", "literal_kind", "refs", "verdict", "container_start", "container_end", "suffix"]
TEXT = """class Zoo {
  // counts pets
  int total; // of all
  int getTotal() { /* x */ return total + Feed.of("pets"); }
  void main() { log("a-b"); }
}"""


def at(text, word, nth=0):
    i = -1
    for _ in range(nth + 1):
        i = text.index(word, i + 1)
    return i, i + len(word)


def row(doc, word, nth=0, text=TEXT, **over):
    a, b = at(text, word, nth)
    base = dict.fromkeys(NAMES) | {"doc_id": doc, "kind": "symbol", "start": a, "end": b, "name_start": a, "name_end": b, "language": "JAVA", "written": word, "declared_name": word, "qualified": True, "origin": "IN_CONTENT", "package_name": "zoo.app", "roots": [], "siblings": [], "refs": []}
    return tuple((base | over)[k] for k in NAMES)


def evidence(doc):
    getter = {"field_key": "field:Zoo#total", "field_name": "total", "prefix": "get", "siblings": [("method:Zoo#setTotal", "setTotal", "set", "field:Zoo#total", True)]}
    return [
        row(doc, "Zoo", key="class:Zoo", role="TYPE"),
        row(doc, "// counts pets", kind="comment", verdict="PROSE"),
        row(doc, "total", key="field:Zoo#total", role="FIELD"),
        row(doc, "// of all", kind="comment", verdict="CODE"),
        row(doc, "all", key="field:Zoo#all", role="FIELD", container_start=at(TEXT, "// of all")[0], container_end=at(TEXT, "// of all")[1]),
        row(doc, "getTotal", key="method:Zoo#getTotal", role="METHOD", **getter),
        row(doc, "/* x */", kind="comment", verdict="CODE"),
        row(doc, "total", 1, key="field:Zoo#total", role="FIELD"),
        row(doc, "Feed", key="class:lib.Feed", role="TYPE", origin="LIBRARY", package_name="lib.feed.core"),
        row(doc, "of", 1, key="method:lib.Feed#of", role="METHOD", origin="LIBRARY", package_name="other"),
        row(doc, '"pets"', kind="literal", literal_kind="STRING", name_start=at(TEXT, '"pets"')[0] + 1, name_end=at(TEXT, '"pets"')[1] - 1),
        row(doc, "main", key="method:Zoo#main", role="METHOD"),
        row(doc, "log", key="unresolved:log", role="METHOD", origin="UNRESOLVED", qualified=False),
        row(doc, '"a-b"', kind="literal", literal_kind="STRING", name_start=at(TEXT, '"a-b"')[0] + 1, name_end=at(TEXT, '"a-b"')[1] - 1, refs=[(at(TEXT, "a-b")[0], at(TEXT, "a-b")[0] + 1, True), (at(TEXT, "a-b")[0] + 2, at(TEXT, "a-b")[1], True)]),
        row(doc, "a-b", key="field:Zoo#a", role="FIELD", end=at(TEXT, "a-b")[0] + 1, name_end=at(TEXT, "a-b")[0] + 1, declared_name="a", written="a"),
    ]


@pytest.fixture(scope="module")
def run(spark):
    subjects = spark.createDataFrame([("p", 1, 1, TEXT, False, "zoo.app"), ("p", 2, 2, TEXT, True, "zoo.app")], "project_id string, seq long, doc_id long, text string, keep_comments boolean, root_package string")
    prefixes = spark.createDataFrame([("lib.feed", True), ("lib", False), (" ", True)], "prefix string, internal boolean")
    frame = spark.createDataFrame(evidence(1) + evidence(2), EVIDENCE)
    out, done, named = snippets.anonymize(subjects, frame, prefixes)
    return {r.doc_id: r.anonymized for r in out.collect()}, done.cache(), named.cache()


def test_text_with_and_without_comments(run):
    text, _, _ = run
    assert text[1] == """class Type1 {
  int field2;
  int getField2() { return field2 + Type3.of("str4"); }
  void main() { Unknown5("field6-b"); }
}"""
    assert text[2] == """class Type1 {
  // counts pets
  int field2; // of field7
  int getField2() { /* x */ return field2 + Type3.of("str8"); }
  void main() { Unknown9("field6-b"); }
}"""


def test_ledger_and_siblings(run):
    _, _, named = run
    delta = {r.key: (r.placeholder, r.original) for r in naming.ledger_delta(named).collect()}
    assert delta == {"class:Zoo": ("Type1", "Zoo"), "field:Zoo#total": ("field2", "total"), "method:Zoo#getTotal": ("getField2", "getTotal"), "method:Zoo#setTotal": ("setField2", "setTotal"), "class:lib.Feed": ("Type3", "Feed"), "field:Zoo#a": ("field6", "a"), "field:Zoo#all": ("field7", "all")}
    assert naming.delta_heads(named).collect() == [("p", 10, [])]


def test_reports_of_a_snippet(run):
    _, done, _ = run
    unknown = [tuple(r) for r in snippets.unknown_names(done).orderBy("doc_id").collect()]
    assert [(u[0], u[1], u[3], u[4], u[5]) for u in unknown] == [(1, "unresolved:log", "log", "Unknown5", True), (2, "unresolved:log", "log", "Unknown9", True)]
    comments = {r.doc_id: (r.prose, r.code, r.anonymized) for r in snippets.comment_counts(done).collect()}
    assert comments == {1: (1, 2, 0), 2: (0, 0, 1)}
    flat = done.sparkSession.createDataFrame([(1, "x", ["Type1", "field2", "col3"]), (3, "y", ["a1", "b2"])], "doc_id long, original string, placeholders array<string>")
    said = {r.doc_id: r.notices for r in reports.notices(flat, snippets.comment_counts(done)).collect()}
    assert said == {1: ["Type1, field2 and col3 were the same name", "3 comments stripped"], 3: ["a1 and b2 were the same name"]}
    counts = done.sparkSession.createDataFrame([(3, 1, 0, 2, 0), (3, 2, 1, 2, 1)], "replaced int, unknown int, unknown_from_comments int, preserved int, comments_anonymized int")
    assert [r.said for r in reports.counts_text(counts).collect()] == ["3 renamed · 1 unknown · 2 preserved", "3 renamed · 2 unknown (1 from comments) · 2 preserved · 1 comment anonymized"]
    assert reports.counts_text(counts, "PLAN", True).first().said == "3 names replaced · 2 preserved"
    mapped = {(r.doc_id, r.placeholder): (r.original, r.kind) for r in snippets.mapping(done).collect()}
    assert mapped[1, "Unknown5"] == ("log", "UNKNOWN") and mapped[1, "str4"][1] == "LITERAL" and mapped[2, "field7"] == ("all", "FIELD")


def test_kotlin_spelling_remainders_and_roots(spark):
    text = "pet.total = 1; Zoo$Gone"
    subjects = spark.createDataFrame([("p", 1, 1, text, False, None)], "project_id string, seq long, doc_id long, text string, keep_comments boolean, root_package string")
    rows = [
        row(1, "total", text=text, key="method:Pet#getTotal", role="METHOD", language="KOTLIN", declared_name="getTotal", field_key="field:Pet#total", field_name="total", prefix="get", origin="LIBRARY", package_name="zoo.app.x"),
        row(1, "Zoo", text=text, key="class:Zoo", role="TYPE"),
        row(1, "Gone", text=text, key="remainder:0", role="TYPE", origin="UNRESOLVED", remainder=True, ticked=True, qualified=False),
    ]
    frame = spark.createDataFrame(rows, EVIDENCE)
    none = spark.createDataFrame([], "prefix string, internal boolean")
    out, done, _ = snippets.anonymize(subjects, frame, none, from_owned_types=True)
    assert out.first().anonymized == "pet.field1 = 1; Type2$Unknown3"
    assert [(r.name, r.preservable) for r in snippets.unknown_names(done).collect()] == [("(generated)", False)]
    assert [(r.original, r.decoding) for r in snippets.mapping(done).where("remainder").collect()] == [("(generated)", "Gone")]
    out, _, _ = snippets.anonymize(subjects, frame, none, from_owned_types=True, detect=False)
    assert out.first().anonymized == "pet.total = 1; Type1$Unknown2"


def test_plan_leaks(spark):
    text = 'Seq Scan on "Pet""s" p  (cost=0.1..2)\n  Filter: (kind = 5kB AND `a b` > [x.y]) "open AND'
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    universe = {r.spelling: r.delimited for r in leaks.plan_universe(frame, "PostgreSQL").collect()}
    assert universe == {"Pet": True, "s": True, 'Pet"s': True, "p": False, "cost": False, "kind": False, "a": True, "b": True, "x": True, "y": True, "x.y": True, "Seq": False, "Scan": False, "on": False, "Filter": False, "open": False} and "AND" not in universe
    found = leaks.plan_survivors(leaks.plan_universe(frame, "PostgreSQL"), spark.createDataFrame([(1, "table1\nkind x\nx")], "doc_id long, text string"))
    assert sorted((r.spelling, r.line) for r in found.collect()) == [("kind", 2), ("x", 2)]
    mine = leaks.plan_universe(frame, "PostgreSQL")
    proof = leaks.sound(mine, frame, found, leaks.plan_survivors(mine, frame)).first()
    assert proof.can_fail and proof.survivors == 2
    empty = leaks.plan_universe(frame, "PostgreSQL").where("false")
    assert not leaks.sound(empty, frame, empty, empty).first().can_fail


def test_source_and_trace_leaks(spark):
    names = spark.createDataFrame([("Zoo",), ("zoo.Pets",), ("List",), ("Inner",)], "name string")
    library = spark.createDataFrame([("List",)], "name string")
    out = spark.createDataFrame([(1, "List x\nzoo.Pets.of(Zoo$Inner)")], "doc_id long, text string")
    assert sorted(map(tuple, leaks.source_survivors(names, library, out).select("name", "line").collect())) == [("zoo.Pets", 2)]
    assert sorted(map(tuple, leaks.source_survivors(names, library, out, binary=True).select("name", "line").collect())) == [("Inner", 2), ("Zoo", 2), ("zoo.Pets", 2)]
    trace = spark.createDataFrame([(1, "zoo.Bad: no\n\tat zoo.Pets$Cage.open(Pets.java:3)\n\t... 2 more")], "doc_id long, text string")
    universe = leaks.trace_universe(trace, library)
    assert {r["name"] for r in universe.collect()} == {"zoo", "Bad", "no", "Pets", "Cage", "open", "java"}
    left = leaks.trace_survivors(universe, spark.createDataFrame([(1, "a.B\n\tat Type1$Cage.x(Unknown Source)")], "doc_id long, text string"))
    assert [(r["name"], r.line) for r in left.collect()] == [("Cage", 2)]


def test_queries_in_strings(spark):
    def names(text):
        return [(text[a:b], role, key.split(":")[0]) for a, b, role, key in sql_names.names_in(text)]

    assert names("SELECT p.kind, count(*) AS n FROM zoo.pets p, cages WHERE p.id = 5 AND name LIKE 'x%'") == [
        ("p", "TABLE", "sql-declared"), ("kind", "COLUMN", "sql"), ("n", "COLUMN", "sql"), ("zoo", "SCHEMA", "sql"), ("pets", "TABLE", "sql"), ("p", "TABLE", "sql-declared"), ("cages", "TABLE", "sql"),
        ("p", "TABLE", "sql-declared"), ("id", "COLUMN", "sql"), ("name", "COLUMN", "sql"),
    ]
    assert names('insert into "Pets" values (1, upper(\'a\'))') == [("Pets", "TABLE", "sql")]
    bad = {"hello": "NOT_SQL", "": "NOT_SQL", "select 'x": "DOES_NOT_PARSE", "select (a": "DOES_NOT_PARSE", "select ? from t": "BIND_PARAMETER", "select :x": "BIND_PARAMETER", "select a.b.c.d": "UNPROJECTABLE_REFERENCE", "select mine(a)": "UNPROJECTABLE_REFERENCE", "select a # b": "UNCLAIMED_TOKEN"}
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*bad, "select a from Pets", "select a from pets"])], "doc_id long, text string")
    read = sql_names.read_queries(frame)
    assert {r.text: r.reason for r in read.collect() if r.reason} == bad
    sweep = {r.outcome: (r.fragments, r.share) for r in sql_names.query_sweep(read).collect()}
    assert sweep["CLAIMED"] == (2, "18.2%") and sweep["NOT_SQL"] == (2, "18.2%")
    assert [tuple(r) for r in sql_names.tables_written_two_ways(read).collect()] == [("pets", ["Pets", "pets"])]
    assert sql_names.fallbacks(read).first().n == 2 and {r.role: r["names"] for r in sql_names.claimed_roles(read).collect()} == {"TABLE": 2, "COLUMN": 2}


def test_members_files_and_masked_messages(spark):
    frames = spark.createDataFrame([("p", "a.T", "a.T", "run$1", "T.java"), ("p", "a.T$I", "a.T$I", "go", "T.kt"), ("p", "b.X", None, "go", None)], "project_id string, type string, resolved string, method string, file string")
    symbols = spark.createDataFrame([("p", "a.T", None, "T", "java"), ("p", "a.T", "run", None, None), ("p", "a.T$I", "go", None, None)], "project_id string, binary_name string, member string, file_stem string, extension string")
    got = {r.type: (r.method_resolved, r.method_remainder, r.file_known, r.extension) for r in traces.resolve_members(frames, symbols).collect()}
    assert got == {"a.T": ("run", "1", True, "java"), "a.T$I": ("go", None, False, None), "b.X": (None, "go", False, None)}
    text = 'Exception in thread "my" thread" zoo.Bad: no food\n\tat zoo.A.b(A.java:1)\nCaused by: zoo.Worse: a: b\n\tat zoo.A.<init>(Native Method)'
    read = traces.parse_traces(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"))
    assert [r.masked for r in traces.masked_texts(read, 5).collect()] == [text.replace('my" thread', "str5").replace("no food", "str6").replace("a: b", "str7")]
    sweep = spark.createDataFrame([("p", 1, "owned"), ("p", 1, "partial"), ("p", 1, "owned")], "project_id string, doc_id long, class string")
    assert [tuple(r) for r in traces.trace_sweep(sweep).collect()] == [("p", 1, 2, 0, 0, 1, 3)]


def test_resets_settings_gates_and_ranges(spark):
    ledger = spark.createDataFrame([("p", "k", "Type1", "A"), ("q", "k", "Type1", "B")], "project_id string, key string, placeholder string, original string")
    runs = spark.createDataFrame([("p", 1), ("q", 1)], "project_id string, seq long")
    heads = spark.createDataFrame([("p", 5, ["s"]), ("q", 6, ["t"])], "project_id string, next_number int, stems array<string>")
    rows, history, after = state.reset(ledger, runs, heads, spark.createDataFrame([("p",)], "project_id string"))
    assert [r.project_id for r in rows.collect()] == [r.project_id for r in history.collect()] == ["q"] and sorted(map(tuple, after.collect())) == [("p", 5, []), ("q", 6, ["t"])]
    schema = "project_id string, detect_roots boolean, internal array<string>, third_party array<string>"
    stored = spark.createDataFrame([("p", False, ["a"], ["b"]), ("q", True, ["c", "c", " "], None)], schema)
    got = state.settings(stored, spark.createDataFrame([("p", None, [" z "], [])], schema))
    assert sorted(map(tuple, got.collect())) == [("p", True, ["z"], []), ("q", True, ["c"], [])]
    assert [r.seq for r in state.rerun(heads, heads.where("project_id = 'p'").withColumn("next_number", F.lit(4)), runs).collect()] == [1]
    files = spark.createDataFrame([("a/B.java",), ("c.KT",), ("d.txt",), ("dir.java/none",)], "path string")
    assert sorted((r.path, r.offered, r.refusal) for r in reports.source_gate(files, kotlin=False).collect()) == [("a/B.java", True, None), ("c.KT", False, "PATH_NOT_ACTIVATED")]
    segments = spark.createDataFrame([(1, 0, 5, 10, 15), (1, 5, 6, 15, 17), (1, 6, 9, 17, 20)], "doc_id long, inner_start int, inner_end int, host_start int, host_end int")
    ranges = spark.createDataFrame([(1, 1, 4), (1, 4, 7), (1, 6, 8)], "doc_id long, start int, end int")
    assert sorted((r.start, r.host_from, r.host_to) for r in reports.host_ranges(ranges, segments).collect()) == [(1, 11, 14), (4, None, None), (6, 17, 19)]
    fixtures = spark.createDataFrame([("f", "visits AND secret")], "name string, text string")
    word = lambda *x: spark.createDataFrame([(y,) for y in x], "word string")
    assert [tuple(r) for r in reports.provenance(fixtures, word("visits"), word("AND")).collect()] == [("f", "secret", 1)]
    kinds = spark.range(1).select(policy.mapped_kind(F.lit("symbol"), F.lit("UNRESOLVED"), F.lit("TYPE")).alias("a"), policy.mapped_kind(F.lit("literal"), F.lit(None), F.lit(None)).alias("b"), policy.mapped_kind(F.lit("symbol"), F.lit("JDK"), F.lit("FIELD")).alias("c")).first()
    assert tuple(kinds) == ("UNKNOWN", "LITERAL", "FIELD")
    members = spark.createDataFrame([("C", "total", "FIELD", "Zoo", None, "sum")], "class_name string, member string, role string, file_stem string, module string, jvm_name string")
    assert {r.spelling for r in reports.source_spellings(members).collect()} == {"total", "getTotal", "setTotal", "ZooKt", "sum"}
