r"""Queries over snippets, ledgers, traces and reports: evidence made from the supplied columns, and what becomes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import leaks, naming, policy, reports, reversal, snippets, sql_names, state, traces
from .registry import duck, query, read

# A snippet a row: `int w<key>; // <word> note`, a call of an unresolved name, and a literal.
SNIPPETS = """
SELECT concat('p', p_size) AS project_id, CAST(p_partkey AS BIGINT) AS seq, CAST(p_partkey AS BIGINT) AS doc_id, p_partkey % 2 = 0 AS keep_comments, CAST('zoo.app' AS STRING) AS root_package,
  concat('int w', p_partkey, '; // ', split_part(p_name, ' ', 1), ' note', chr(10), 'call', p_size, '(w', p_partkey, ', "', p_brand, '");') AS text FROM part"""
_NONE = "CAST(NULL AS STRING)"
_OCCURRENCE = f"""doc_id, {{kind}} AS kind, CAST({{a}} AS INT) AS start, CAST({{b}} AS INT) AS end_, CAST({{c}} AS INT) AS name_start, CAST({{d}} AS INT) AS name_end, 'JAVA' AS language, {{said}} AS written, {{key}} AS key, {{role}} AS role, {{origin}} AS origin,
  {{said}} AS declared_name, 'zoo.app' AS package_name, {{qualified}} AS qualified, false AS remainder, false AS ticked, {_NONE} AS stem, {_NONE} AS field_key, {_NONE} AS field_name, CAST(NULL AS BOOLEAN) AS field_qualified, {_NONE} AS field_stem, {_NONE} AS prefix,
  {{literal}} AS literal_kind, {{verdict}} AS verdict, CAST(NULL AS INT) AS container_start, CAST(NULL AS INT) AS container_end, {_NONE} AS suffix"""


def _occurrence(kind: str, a: str, b: str, **over: str) -> str:
    fields = {"kind": f"'{kind}'", "a": a, "b": b, "c": a, "d": b, "said": f"substr(text, {a} + 1, {b} - ({a}))", "key": _NONE, "role": _NONE, "origin": _NONE, "qualified": "false", "literal": _NONE, "verdict": _NONE} | over
    return f"SELECT {_OCCURRENCE.format(**fields)} FROM s"


_LINE = "strpos(text, chr(10))"
EVIDENCE = f"WITH s AS ({SNIPPETS}) " + " UNION ALL ".join(
    [
        _occurrence("symbol", "4", "strpos(text, ';') - 1", key="concat('field:Zoo#', doc_id)", role="'FIELD'", origin="'IN_CONTENT'", qualified="true"),
        _occurrence("comment", "strpos(text, '//') - 1", f"{_LINE} - 1", verdict="'PROSE'"),
        _occurrence("symbol", _LINE, "strpos(text, '(') - 1", key="concat('unresolved:call', substr(project_id, 2))", role="'METHOD'", origin="'UNRESOLVED'"),
        _occurrence("symbol", "strpos(text, '(')", "strpos(text, ',') - 1", key="concat('field:Zoo#', doc_id)", role="'FIELD'", origin="'IN_CONTENT'", qualified="true"),
        _occurrence("literal", "strpos(text, '\"') - 1", "length(text) - 2", c="strpos(text, '\"')", d="length(text) - 3", literal="'STRING'"),
    ]
)


def _snippets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    empty = lambda t: F.array().cast(t)
    evidence = read(spark, d, EVIDENCE.replace("strpos(", "instr(")).withColumnRenamed("end_", "end")
    evidence = evidence.withColumn("roots", empty("array<struct<key:string,origin:string,package:string,qualified:boolean>>")).withColumn("siblings", empty(f"array<{naming.SIBLING}>")).withColumn("refs", empty("array<struct<start:int,end:int,resolved:boolean>>"))
    prefixes = spark.createDataFrame([], "prefix string, internal boolean")
    return snippets.anonymize(read(spark, d, SNIPPETS), evidence, prefixes)


# Three numbers a snippet, in the order of its project: field, unknown, literal.
_RANKED = f"SELECT *, 3 * (row_number() OVER (PARTITION BY project_id ORDER BY seq) - 1) AS n FROM ({duck(SNIPPETS)})"


@query(f"""SELECT doc_id, concat('int field', n + 1, CASE WHEN keep_comments THEN concat('; ', regexp_extract(text, '//[^\\n]*')) ELSE ';' END, chr(10), 'Unknown', n + 2, '(field', n + 1, ', "str', n + 3, '");') AS anonymized FROM ({_RANKED})""")
def snippet_anonymize(spark: SparkSession, d: str) -> DataFrame:
    return _snippets(spark, d)[0].select("doc_id", "anonymized")


@query(f"SELECT doc_id, concat('unresolved:call', substr(project_id, 2)) AS key, concat('call', substr(project_id, 2)) AS name, concat('Unknown', n + 2) AS placeholder, true AS preservable FROM ({_RANKED})")
def snippet_unknowns(spark: SparkSession, d: str) -> DataFrame:
    return snippets.unknown_names(_snippets(spark, d)[1]).drop("at")


@query(f"SELECT doc_id, CAST(CASE WHEN keep_comments THEN 0 ELSE 1 END AS BIGINT) AS prose, CAST(0 AS BIGINT) AS code, CAST(0 AS BIGINT) AS anonymized FROM ({duck(SNIPPETS)})")
def snippet_comments(spark: SparkSession, d: str) -> DataFrame:
    return snippets.comment_counts(_snippets(spark, d)[1])


@query(f"""SELECT doc_id, unnest([concat('field', n + 1), concat('Unknown', n + 2), concat('str', n + 3)]) AS placeholder, unnest([concat('w', doc_id), concat('call', substr(project_id, 2)), regexp_extract(text, '"[^"]*"')]) AS original, unnest(['FIELD', 'UNKNOWN', 'LITERAL']) AS kind FROM ({_RANKED})""")
def snippet_mapping(spark: SparkSession, d: str) -> DataFrame:
    return snippets.mapping(_snippets(spark, d)[1]).select("doc_id", "placeholder", "original", "kind")


@query(f"SELECT project_id, concat('field:Zoo#', doc_id) AS key, concat('field', n + 1) AS placeholder, concat('w', doc_id) AS original FROM ({_RANKED})")
def snippet_ledger_delta(spark: SparkSession, d: str) -> DataFrame:
    return naming.ledger_delta(_snippets(spark, d)[2])


# Accessors over a history: each order names one field by its getter, every fourth by a stem of its own.
ACCESSORS = """SELECT CAST(o_custkey AS STRING) AS project_id, CAST(o_orderkey AS BIGINT) AS seq, 0 AS start, concat('m', o_orderkey, '#get') AS key, 'method' AS namespace, concat('getF', o_orderkey) AS original, true AS qualified,
  concat('f', o_orderkey) AS field_key, concat('f', o_orderkey) AS field_name, 'get' AS prefix, CASE WHEN o_orderkey % 4 = 0 THEN 'pet' END AS field_stem FROM orders"""
_FIELD = f"SELECT *, concat(coalesce(field_stem, 'field'), row_number() OVER (PARTITION BY project_id ORDER BY seq)) AS f FROM ({duck(ACCESSORS)})"


@query(f"""SELECT project_id, seq, unnest([key, field_key, concat(field_key, 's')]) AS key, unnest([concat('get', upper(f[1]), f[2:]), f, concat('set', upper(f[1]), f[2:])]) AS placeholder, unnest([original, field_name, concat('setF', seq)]) AS original,
  unnest([true, false, true]) AS derived, unnest([false, false, true]) AS sibling, true AS fresh FROM ({_FIELD})""")
def sibling_rows(spark: SparkSession, d: str) -> DataFrame:
    sibling = F.struct(F.concat("field_key", F.lit("s")).alias("key"), F.concat(F.lit("setF"), F.col("seq")).alias("original"), F.lit("set").alias("prefix"), F.col("field_key"), F.lit(True).alias("qualified"))
    return naming.name_symbols(read(spark, d, ACCESSORS).withColumn("siblings", F.array(sibling))).select("project_id", "seq", "key", "placeholder", "original", "derived", "sibling", "fresh")


@query(f"SELECT project_id, CAST(count(*) + 1 AS INT) AS next_number, CASE WHEN bool_or(field_stem IS NOT NULL) THEN ['getPet', 'pet'] ELSE [] END AS stems FROM ({duck(ACCESSORS)}) GROUP BY project_id")
def recorded_stems(spark: SparkSession, d: str) -> DataFrame:
    return naming.history_heads(read(spark, d, ACCESSORS))


LITERALS = "SELECT CAST(user_id AS STRING) AS project_id, CAST(0 AS BIGINT) AS seq, CAST(event_id AS INT) AS start, CAST(event_type AS STRING) AS key, 'str' AS namespace, CAST(event_type AS STRING) AS original, false AS qualified, true AS literal FROM events"


@query(f"SELECT project_id, start, original, concat('str', row_number() OVER (PARTITION BY project_id ORDER BY start)) AS placeholder FROM ({duck(LITERALS)})")
def literal_numbers(spark: SparkSession, d: str) -> DataFrame:
    return naming.name_symbols(read(spark, d, LITERALS)).select("project_id", "start", "original", "placeholder")


@query(f"""WITH h AS (SELECT user_id, event_id, event_type, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events),
n AS (SELECT user_id, event_type, first, 6 + row_number() OVER (PARTITION BY user_id ORDER BY first) AS number FROM (SELECT DISTINCT user_id, event_type, first FROM h WHERE event_type <> 'click'))
SELECT CAST(h.user_id AS VARCHAR) AS project_id, CAST(event_id AS INT) AS start, coalesce('Type' || number, 'Type2') AS placeholder FROM h LEFT JOIN n ON h.user_id = n.user_id AND h.event_type = n.event_type""")
def ledger_reuse(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "SELECT CAST(user_id AS STRING) AS project_id, CAST(0 AS BIGINT) AS seq, CAST(event_id AS INT) AS start, CAST(event_type AS STRING) AS key, 'Type' AS namespace, CAST(event_type AS STRING) AS original, true AS qualified, array('Type2') AS reserved FROM events")
    projects = rows.select("project_id").distinct()
    ledger = projects.select("project_id", F.lit("click").alias("key"), F.lit("Type2").alias("placeholder"), F.lit("x").alias("original"))
    heads = projects.select("project_id", F.lit(7).alias("next_number"), F.array().cast("array<string>").alias("stems"))
    return naming.name_symbols(rows, ledger, heads).where("start is not null").select("project_id", "start", "placeholder")


POLICY = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'IN_CONTENT' WHEN 1 THEN 'LIBRARY' WHEN 2 THEN 'JDK' ELSE 'UNRESOLVED' END AS origin, CASE c_custkey % 5 WHEN 0 THEN 'TYPE' WHEN 1 THEN 'FIELD' WHEN 2 THEN 'TABLE' WHEN 3 THEN 'ANNOTATION' ELSE 'INDEX' END AS role,
  c_custkey % 3 = 0 AS claimed, c_custkey % 7 = 0 AS literal FROM customer"""


@query(f"""SELECT id, coalesce(origin = 'IN_CONTENT' OR (origin = 'LIBRARY' AND claimed), false) AS owned, CASE WHEN origin = 'UNRESOLVED' THEN 'Unknown' ELSE CASE role WHEN 'TYPE' THEN 'Type' WHEN 'FIELD' THEN 'field' WHEN 'TABLE' THEN 'table' WHEN 'ANNOTATION' THEN 'Anno' ELSE 'idx' END END AS namespace,
  CASE WHEN literal THEN 'LITERAL' WHEN origin = 'UNRESOLVED' THEN 'UNKNOWN' ELSE role END AS kind FROM ({duck(POLICY)})""")
def policy_columns(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, POLICY)
    kind = F.when(F.col("literal"), "literal").otherwise("symbol")
    return p.select("id", policy.owned(F.col("origin"), F.col("claimed")).alias("owned"), policy.namespace(F.col("origin"), F.col("role")).alias("namespace"), policy.mapped_kind(kind, F.col("origin"), F.col("role")).alias("kind"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'preserve' WHEN p_partkey % 5 = 1 THEN 'splice' ELSE 'str' END AS coverage FROM part""")
def literal_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'CHAR' ELSE 'STRING' END AS kind, concat(split_part(p_name, ' ', 1), CASE WHEN p_partkey % 5 = 2 THEN 'z' ELSE '.' END, p_size) AS text, split_part(p_name, ' ', 1) AS w FROM part")
    span = lambda a, b, ok=True: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(ok).alias("resolved"))
    n, w = F.length("text"), F.length("w")
    # both parts named; one of them; the two overlapping
    refs = F.when(F.col("id") % 5 == 3, F.array(span(F.lit(0), w))).when(F.col("id") % 5 == 4, F.array(span(F.lit(0), w + 2), span(w + 1, n))).otherwise(F.array(span(w + 1, n), span(F.lit(0), w)))
    return p.select("id", policy.literal_coverage(F.col("kind"), F.lit(0), n, F.col("text"), refs).alias("coverage"))


OWNED_TYPES = "SELECT CAST(p_size AS BIGINT) AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 'IN_CONTENT' ELSE 'LIBRARY' END AS origin, 'TYPE' AS role, concat('com.', split_part(p_name, ' ', 1), '.x') AS package_name FROM part"


@query(f"SELECT doc_id, list_sort(list(DISTINCT regexp_extract(package_name, '^[^.]*[.][^.]*'))) AS roots FROM ({duck(OWNED_TYPES)}) WHERE origin = 'IN_CONTENT' GROUP BY doc_id")
def root_packages(spark: SparkSession, d: str) -> DataFrame:
    return snippets.root_packages(read(spark, d, "SELECT 1 AS doc_id, 'x' AS root_package"), read(spark, d, OWNED_TYPES), from_owned_types=True)


RENAMES = "SELECT concat('p', c_nationkey) AS project_id, concat('k', c_custkey % 50) AS key, c_custkey AS ordinal, CASE WHEN c_custkey % 5 <> 0 THEN concat('Type', c_custkey) END AS placeholder, CASE WHEN c_custkey % 6 = 0 THEN 'UNKNOWN' ELSE 'TYPE' END AS kind, c_custkey % 3 = 0 AS derived FROM customer"
HELD = "SELECT DISTINCT concat('p', n_nationkey) AS project_id, concat('k', n_nationkey) AS key FROM nation"


@query(f"SELECT ordinal, CASE WHEN placeholder IS NULL OR kind = 'UNKNOWN' THEN 'NONE' WHEN EXISTS (SELECT 1 FROM ({duck(HELD)}) h WHERE h.project_id = r.project_id AND h.key = r.key) THEN 'ESTABLISHED' WHEN derived THEN 'DERIVED' ELSE 'OFFERED' END AS renaming FROM ({duck(RENAMES)}) r")
def rename_status(spark: SparkSession, d: str) -> DataFrame:
    return reports.rename_status(read(spark, d, RENAMES), read(spark, d, HELD)).select("ordinal", "renaming")


FLAT = "SELECT n_nationkey AS doc_id, n_name AS original, CAST(n_regionkey AS INT) AS many FROM nation"


@query(f"""SELECT doc_id, list_filter([CASE WHEN many > 1 THEN concat(CASE many WHEN 2 THEN 'a0' WHEN 3 THEN 'a0, a1' ELSE 'a0, a1, a2' END, ' and a', many - 1, ' were the same name') END, CASE WHEN doc_id % 3 = 1 THEN '1 comment stripped' WHEN doc_id % 3 = 2 THEN '2 comments stripped' END], lambda x: x IS NOT NULL) AS notices
  FROM ({duck(FLAT)}) WHERE many > 1 OR doc_id % 3 > 0""")
def fidelity_notices(spark: SparkSession, d: str) -> DataFrame:
    flat = read(spark, d, FLAT).where("many > 1").select("doc_id", "original", F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda i: F.concat(F.lit("a"), i.cast("string"))).alias("placeholders"))
    comments = read(spark, d, "SELECT n_nationkey AS doc_id, n_nationkey % 3 AS prose, 0 AS code FROM nation")
    return reports.notices(flat, comments)


@query("""SELECT n_nationkey AS doc_id, concat(n_nationkey, ' renamed · ', n_regionkey, ' unknown', CASE WHEN n_regionkey > 2 THEN concat(' (', n_regionkey - 2, ' from comments)') ELSE '' END, ' · 7 preserved', CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' · 1 comment anonymized' ELSE ' · 2 comments anonymized' END) AS said FROM nation""")
def counts_text(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "SELECT n_nationkey AS doc_id, n_nationkey AS replaced, n_regionkey AS unknown, greatest(n_regionkey - 2, 0) AS unknown_from_comments, 7 AS preserved, n_nationkey % 3 AS comments_anonymized FROM nation")
    return reports.counts_text(counts).select("doc_id", "said")


STATE = "SELECT concat('p', c_nationkey) AS project_id, concat('k', c_custkey) AS key, concat('Type', c_custkey) AS placeholder, c_name AS original FROM customer"
STATE_HEADS = "SELECT concat('p', n_nationkey) AS project_id, n_nationkey + 5 AS next_number FROM nation"


@query("SELECT concat('p', c_nationkey) AS project_id, concat('k', c_custkey) AS key FROM customer WHERE c_nationkey % 3 <> 0")
def ledger_clear(spark: SparkSession, d: str) -> DataFrame:
    return state.clear_rows(read(spark, d, STATE), read(spark, d, STATE_HEADS).where("substring(project_id, 2) % 3 = 0")).select("project_id", "key")


@query("SELECT concat('p', n_nationkey) AS project_id, n_nationkey + 5 AS next_number, CASE WHEN n_nationkey % 3 = 0 THEN [] ELSE ['pet'] END AS stems, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND n_nationkey % 3 <> 0) AS rows_left FROM nation")
def ledger_reset(spark: SparkSession, d: str) -> DataFrame:
    heads, rows = read(spark, d, STATE_HEADS).withColumn("stems", F.array(F.lit("pet"))), read(spark, d, STATE)
    left, _, after = state.reset(rows, rows, heads, heads.where("substring(project_id, 2) % 3 = 0"))
    return after.join(left.groupBy("project_id").agg(F.count("*").alias("n")), "project_id", "left").select("project_id", "next_number", "stems", F.coalesce("n", F.lit(0)).alias("rows_left"))


@query("SELECT concat('p', n_nationkey) AS project_id, n_nationkey % 4 <> 0 AS stale FROM nation")
def stale_projects(spark: SparkSession, d: str) -> DataFrame:
    heads = read(spark, d, STATE_HEADS)
    return state.is_stale(heads, heads.withColumn("next_number", F.col("next_number") - F.substring("project_id", 2, 9).cast("int") % 4))


@query("SELECT concat('k', c_custkey) AS key FROM customer WHERE c_nationkey % 4 <> 0")
def stale_reruns(spark: SparkSession, d: str) -> DataFrame:
    heads = read(spark, d, STATE_HEADS)
    return state.rerun(heads, heads.withColumn("next_number", F.col("next_number") - F.substring("project_id", 2, 9).cast("int") % 4), read(spark, d, STATE)).select("key")


@query("SELECT concat('p', n_nationkey) AS project_id, n_nationkey % 2 = 0 OR n_nationkey < 10 AS detect_roots, CASE WHEN n_nationkey < 10 THEN ['new'] ELSE ['a', lower(n_name)] END AS internal, [] AS third_party FROM nation")
def stored_settings(spark: SparkSession, d: str) -> DataFrame:
    old = read(spark, d, "SELECT concat('p', n_nationkey) AS project_id, n_nationkey % 2 = 0 AS detect_roots, array(lower(n_name), ' ', 'a', 'a') AS internal, CAST(array() AS array<string>) AS third_party FROM nation")
    new = old.where("substring(project_id, 2) < 10").select("project_id", F.lit(None).cast("boolean").alias("detect_roots"), F.array(F.lit(" new ")).alias("internal"), F.lit(None).cast("array<string>").alias("third_party"))
    return state.settings(old, new)


@query("SELECT event_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN 'none' WHEN event_id % 3 = 1 THEN 'pasted' ELSE 'refused' END AS verdict FROM events")
def paste_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "SELECT event_id AS doc_id, CASE WHEN event_id % 3 > 0 THEN array('Type1') ELSE CAST(array() AS array<string>) END AS restored, CASE WHEN event_id % 3 = 2 THEN array(event_type) ELSE CAST(array() AS array<string>) END AS unrestored FROM events")
    return reversal.paste_verdict(rows).select("doc_id", "verdict")


MARKED = r"""SELECT o_orderkey AS doc_id, concat('zoo.Bad', CASE WHEN o_orderkey % 3 = 0 THEN concat(': no ', o_custkey) ELSE '' END, chr(10), chr(9), 'at _COROUTINE._BOUNDARY._(CoroutineDebugging.kt:', o_custkey, ')', chr(10),
  CASE WHEN o_orderkey % 4 = 0 THEN '  (Coroutine boundary)' WHEN o_orderkey % 4 = 1 THEN '  (Coroutine edge)' ELSE concat(chr(9), '... ', o_custkey, ' more') END, chr(10), chr(9), 'at zoo.A.run', o_custkey, '(A.java:', o_custkey % 90, ')') AS text FROM orders"""


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'not_a_trace' ELSE 'read' END AS status, CASE WHEN doc_id % 4 <> 1 THEN CAST(1 AS INT) END AS frames FROM ({duck(MARKED)})")
def coroutine_markers(spark: SparkSession, d: str) -> DataFrame:
    return traces.parse_traces(read(spark, d, MARKED)).select("doc_id", "status", F.size("frames").alias("frames")).withColumn("frames", F.when(F.col("frames") >= 0, F.col("frames")))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, 'no \\d+', 'str4') ELSE text END AS masked FROM ({duck(MARKED)}) WHERE doc_id % 4 <> 1")
def trace_messages(spark: SparkSession, d: str) -> DataFrame:
    return traces.masked_texts(traces.parse_traces(read(spark, d, MARKED)), 4).select("doc_id", "masked")


CALLS = "SELECT p_partkey AS id, 'p' AS project_id, concat('a.T', p_size) AS type, CASE WHEN p_partkey % 4 = 3 THEN CAST(NULL AS STRING) ELSE concat('a.T', p_size) END AS resolved, CASE p_partkey % 3 WHEN 0 THEN 'run' WHEN 1 THEN 'run$1' ELSE 'gone' END AS method, concat('T', p_size, CASE WHEN p_partkey % 2 = 0 THEN '.java' ELSE '.kt' END) AS file FROM part"


@query(f"SELECT id, CASE WHEN resolved IS NOT NULL AND method <> 'gone' THEN 'run' END AS method_resolved, CASE WHEN resolved IS NULL OR method = 'gone' THEN method WHEN method = 'run$1' THEN '1' END AS method_remainder, resolved IS NOT NULL AND file LIKE '%.java' AS file_known FROM ({duck(CALLS)})")
def frame_members(spark: SparkSession, d: str) -> DataFrame:
    symbols = read(spark, d, "SELECT DISTINCT 'p' AS project_id, concat('a.T', p_size) AS binary_name, m.member, CASE WHEN m.member IS NULL THEN concat('T', p_size) END AS file_stem, CASE WHEN m.member IS NULL THEN 'java' END AS extension FROM part, (SELECT explode(array('run', NULL)) AS member) m")
    return traces.resolve_members(read(spark, d, CALLS), symbols).select("id", "method_resolved", "method_remainder", "file_known")


SWEPT = "SELECT concat('p', p_size % 5) AS project_id, CAST(p_size AS BIGINT) AS doc_id, CASE WHEN p_partkey % 4 <> 3 THEN concat('a.T', p_size) END AS resolved, CASE WHEN p_partkey % 4 = 2 THEN 'x' END AS remainder FROM part"


@query(f"SELECT project_id, doc_id, count(*) FILTER (resolved IS NOT NULL AND remainder IS NULL AND doc_id % 2 = 0) AS owned, count(*) FILTER (resolved IS NOT NULL AND remainder IS NULL AND doc_id % 2 = 1) AS library, count(*) FILTER (resolved IS NULL) AS unknown, count(*) FILTER (resolved IS NOT NULL AND remainder IS NOT NULL) AS partial, count(*) AS total FROM ({duck(SWEPT)}) GROUP BY project_id, doc_id")
def trace_sweep(spark: SparkSession, d: str) -> DataFrame:
    owned = read(spark, d, "SELECT DISTINCT concat('p', p_size % 5) AS project_id, concat('a.T', p_size) AS binary_name FROM part WHERE p_size % 2 = 0")
    return traces.trace_sweep(traces.classify_frames(read(spark, d, SWEPT), owned))


FILES = "SELECT o_orderkey AS id, concat('a', o_orderkey, chr(10), '---', chr(10), CASE WHEN o_orderkey % 2 = 0 THEN concat('b', chr(10)) ELSE '' END, '-----', chr(10), 'c--') AS text FROM orders"


@query(f"SELECT id, unnest(range(0, 2 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END)) AS part, unnest(CASE WHEN id % 2 = 0 THEN [concat('a', id, chr(10)), concat('b', chr(10)), 'c--'] ELSE [concat('a', id, chr(10)), 'c--'] END) AS text FROM ({duck(FILES)})")
def split_traces(spark: SparkSession, d: str) -> DataFrame:
    return traces.split_traces(read(spark, d, FILES)).withColumn("part", F.col("part").cast("long"))


MEMBERS = "SELECT p_partkey AS id, 'C' AS class_name, split_part(p_name, ' ', 1) AS member, CASE p_partkey % 3 WHEN 0 THEN 'FIELD' WHEN 1 THEN 'TYPE' ELSE 'METHOD' END AS role, CASE WHEN p_partkey % 2 = 0 THEN concat('F', p_size) END AS file_stem, CASE WHEN p_partkey % 5 = 0 THEN 'app' END AS module, CASE WHEN p_partkey % 7 = 0 THEN 'jvm' END AS jvm_name FROM part"


@query(f"""SELECT id, unnest(list_filter(list_distinct([member, CASE WHEN role = 'FIELD' THEN concat('get', upper(member[1]), member[2:]) END, CASE WHEN role = 'FIELD' THEN concat('set', upper(member[1]), member[2:]) END, concat(file_stem, CASE WHEN file_stem IS NOT NULL THEN 'Kt' END), CASE WHEN role = 'TYPE' THEN concat(member, '.INSTANCE') END,
  CASE WHEN role = 'METHOD' AND module IS NOT NULL THEN concat(member, '$', module) END, jvm_name]), lambda x: x IS NOT NULL AND x <> '')) AS spelling FROM ({duck(MEMBERS)})""")
def source_spellings(spark: SparkSession, d: str) -> DataFrame:
    return reports.source_spellings(read(spark, d, MEMBERS)).select("id", "spelling")


OUTPUTS = "SELECT p_partkey AS doc_id, concat('x ', p_size, chr(10), 'zoo.', split_part(p_name, ' ', 1), '.Lib(Own$', split_part(p_name, ' ', 2), ')') AS text FROM part"
OWN = "SELECT DISTINCT concat('zoo.', split_part(p_name, ' ', 1)) AS name FROM part UNION SELECT 'Lib' UNION SELECT 'Own' UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part"


@query(f"SELECT DISTINCT doc_id, name, 2 AS line FROM (SELECT doc_id, unnest([regexp_extract(text, 'zoo[.]\\w+'), 'Own', regexp_extract(text, '[$](\\w+)', 1), regexp_extract(text, 'zoo[.](\\w+)', 1)]) AS name FROM ({duck(OUTPUTS)})) WHERE name IN (SELECT name FROM ({duck(OWN)}))")
def source_survivors(spark: SparkSession, d: str) -> DataFrame:
    return leaks.source_survivors(read(spark, d, OWN), read(spark, d, "SELECT 'Lib' AS name"), read(spark, d, OUTPUTS), binary=True)


TRACED = "SELECT o_orderkey AS doc_id, concat('zoo.Bad', o_custkey, ': oh', chr(10), chr(9), 'at zoo.Pets$Cage.open(Pets.java:3)') AS text FROM orders"


@query(f"SELECT doc_id, name, line FROM (SELECT doc_id, unnest([concat('Bad', regexp_extract(text, 'Bad(\\d+)', 1)), 'Cage']) AS name, unnest([1, 2]) AS line FROM ({duck(TRACED)}))")
def trace_survivors(spark: SparkSession, d: str) -> DataFrame:
    inputs = read(spark, d, TRACED)
    outputs = inputs.select("doc_id", F.concat(F.lit("Type1."), F.regexp_extract("text", r"Bad\d+", 0), F.lit("\n\tat Type2$Cage.x(Unknown Source)")).alias("text"))
    return leaks.trace_survivors(leaks.trace_universe(inputs, read(spark, d, "SELECT 'zoo' AS name")), outputs)


@query(f"SELECT count(*) * 6 AS universe, count(*) * 6 AS found_in_input, count(*) AS survivors, count(*) AS outputs, true AS can_fail FROM ({duck(TRACED)})")
def oracle_proof(spark: SparkSession, d: str) -> DataFrame:
    inputs = read(spark, d, TRACED)
    universe = leaks.trace_universe(inputs, read(spark, d, "SELECT 'zoo' AS name"))
    outputs = inputs.select("doc_id", F.lit("Cage").alias("text"))
    return leaks.sound(universe, outputs, leaks.trace_survivors(universe, outputs), leaks.trace_survivors(universe, inputs))


FRAGMENTS = """SELECT p_partkey AS doc_id, CASE p_partkey % 6 WHEN 0 THEN concat('SELECT a.c', p_size, ', count(*) FROM s.T', p_size, ' a WHERE a.x = ', p_size) WHEN 1 THEN concat('UPDATE t', p_size, ' SET y = upper(z)') WHEN 2 THEN concat('select ? from t', p_size) WHEN 3 THEN p_name WHEN 4 THEN concat('select mine', p_size, '(1)') ELSE concat('select ''', p_size) END AS text FROM part"""


@query(f"""SELECT doc_id, CASE doc_id % 6 WHEN 2 THEN 'BIND_PARAMETER' WHEN 3 THEN 'NOT_SQL' WHEN 4 THEN 'UNPROJECTABLE_REFERENCE' WHEN 5 THEN 'DOES_NOT_PARSE' END AS reason,
  CASE doc_id % 6 WHEN 0 THEN concat('TABLE a,COLUMN c', n, ',SCHEMA s,TABLE T', n, ',TABLE a,TABLE a,COLUMN x') WHEN 1 THEN concat('TABLE t', n, ',COLUMN y,COLUMN z') ELSE '' END AS names FROM (SELECT p_partkey AS doc_id, CAST(p_size AS VARCHAR) AS n FROM part)""")
def sql_fragments(spark: SparkSession, d: str) -> DataFrame:
    said = F.transform("names", lambda n: F.concat_ws(" ", n["role"], F.substring(F.col("text"), n["start"] + 1, n["end"] - n["start"])))
    return sql_names.read_queries(read(spark, d, FRAGMENTS)).select("doc_id", "reason", F.array_join(said, ",").alias("names"))


@query("SELECT outcome, fragments, concat((2000 * fragments + n) // (2 * n) // 10, '.', (2000 * fragments + n) // (2 * n) % 10, '%') AS share FROM (SELECT outcome, count(*) AS fragments, (SELECT count(*) FROM part) AS n FROM (SELECT CASE p_partkey % 6 WHEN 2 THEN 'BIND_PARAMETER' WHEN 3 THEN 'NOT_SQL' WHEN 4 THEN 'UNPROJECTABLE_REFERENCE' WHEN 5 THEN 'DOES_NOT_PARSE' ELSE 'CLAIMED' END AS outcome FROM part) GROUP BY outcome)")
def query_sweep(spark: SparkSession, d: str) -> DataFrame:
    return sql_names.query_sweep(sql_names.read_queries(read(spark, d, FRAGMENTS)))


@query("SELECT concat('t', n) AS folded, [concat('T', n), concat('t', n)] AS ways FROM (SELECT p_size AS n FROM part WHERE p_partkey % 6 = 0 INTERSECT SELECT p_size FROM part WHERE p_partkey % 6 = 1)")
def tables_two_ways(spark: SparkSession, d: str) -> DataFrame:
    return sql_names.tables_written_two_ways(sql_names.read_queries(read(spark, d, FRAGMENTS)))


@query("SELECT p_partkey AS doc_id, s.start, CASE WHEN s.start = 2 THEN s.start + 10 WHEN s.start = 7 THEN s.start + 11 END AS host_from, CASE WHEN s.start = 2 THEN s.stop + 10 WHEN s.start = 7 THEN s.stop + 11 END AS host_to FROM part, (VALUES (2, 4), (4, 7), (7, 9)) s(start, stop)")
def host_ranges(spark: SparkSession, d: str) -> DataFrame:
    ranges = read(spark, d, "SELECT p_partkey AS doc_id, explode(array(named_struct('start', 2, 'end', 4), named_struct('start', 4, 'end', 7), named_struct('start', 7, 'end', 9))) AS r FROM part").select("doc_id", "r.*")
    segments = read(spark, d, "SELECT p_partkey AS doc_id, inline(array(named_struct('inner_start', 0, 'inner_end', 5, 'host_start', 10, 'host_end', 15), named_struct('inner_start', 5, 'inner_end', 6, 'host_start', 15, 'host_end', 17), named_struct('inner_start', 6, 'inner_end', 9, 'host_start', 17, 'host_end', 20))) FROM part")
    return reports.host_ranges(ranges, segments).select("doc_id", "start", "host_from", "host_to")


@query("SELECT path, kind = 0 AS offered, CASE WHEN kind = 1 THEN 'PATH_NOT_ACTIVATED' END AS refusal FROM (SELECT concat('src/', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.java' WHEN 1 THEN '.KT' ELSE '.txt' END) AS path, p_partkey % 3 AS kind FROM part) WHERE kind < 2")
def source_gate(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "SELECT concat('src/', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.java' WHEN 1 THEN '.KT' ELSE '.txt' END) AS path FROM part")
    return reports.source_gate(files, kotlin=False).select("path", "offered", "refusal")


@query("SELECT concat('f', p_size) AS name, split_part(p_name, ' ', 2) AS word, count(*) AS n FROM (SELECT DISTINCT p_partkey, p_size, p_name FROM part) WHERE split_part(p_name, ' ', 2) NOT IN (SELECT split_part(p_name, ' ', 1) FROM part) GROUP BY ALL")
def fixture_provenance(spark: SparkSession, d: str) -> DataFrame:
    fixtures = read(spark, d, "SELECT concat('f', p_size) AS name, concat('Seq ', p_name) AS text FROM part").select("name", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("text"))
    return reports.provenance(fixtures, read(spark, d, "SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part"), read(spark, d, "SELECT 'Seq' AS word"))


@query(r"SELECT doc_id, regexp_replace(text, '\b(\w)', '\1', 'g') = text AS same, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n FROM documents")
def splice_every_word(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "SELECT doc_id, text FROM documents")
    spans = F.filter(X.spans_of(X.tiles(F.col("text"))), lambda s: s["match"].rlike(r"^[\p{L}\p{N}_]"))
    edits = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("text")))
    return t.select("doc_id", (X.splice(F.col("text"), edits) == F.col("text")).alias("same"), F.size(spans).cast("long").alias("n"))
