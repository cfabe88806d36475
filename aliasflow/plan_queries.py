"""Queries over plans: texts made from the columns of part, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import formats, leaks, reports
from .plans import parse, structured
from .registry import duck, made, query, read


def _rewrites(name: str, plan: str, *changes: tuple[str, str]) -> None:
    """Register a query that rewrites a plan; its SQL makes the rewritten text from the same columns."""
    done = plan
    for old, new in changes:
        assert old in done, (name, old)
        done = done.replace(old, new)

    def run(spark: SparkSession, d: str) -> DataFrame:
        return parse.anonymize_plans(read(spark, d, made(plan)))

    run.__name__ = name
    query(duck(made(done)))(run)


_rewrites(
    "plan_parse_json",
    '[ {"Plan": {"Node Type": "Seq Scan", "Relation Name": "r%K", "Alias": "a%N", "Plan Rows": %N, "Filter": "(a%N.c%W = %N)", "Output": ["a%N.x", "lower(y%K)"]}, "Planning Time": 0.%N} ]',
    ("r%K", "table1"), ("a%N", "table2"), ("c%W", "col3"), ("table2.x", "table2.col4"), ("y%K", "col5"),
)
_rewrites(
    "plan_parse_yaml",
    '- Plan: \n    Node Type: "Sort"\n    Sort Key: "k%W"\n    Plans: \n      - Node Type: "Seq Scan"\n        Relation Name: "r%K"\n        Alias: "a%N"\n        Filter: "(a%N.c = \'v%K\')"\n  Planning Time: %N',
    ("k%W", "col1"), ("r%K", "table2"), ("a%N", "table3"), (".c ", ".col4 "), ("v%K", "str5"),
)
_rewrites(
    "plan_parse_xml",
    '<explain xmlns="http://www.postgresql.org/2009/explain"><Query><Plan><Node-Type>Index Scan</Node-Type><Index-Name>i%N</Index-Name><Relation-Name>r%K</Relation-Name><Alias>a%W</Alias><Output><Item>a%W.c%N</Item><Item>%N</Item></Output></Plan></Query></explain>',
    ("i%N", "idx1"), ("r%K", "table2"), ("a%W", "table3"), ("c%N", "col4"),
)
_rewrites(
    "plan_parse_mysql",
    '{\n  "query": "select %K",\n  "inputs": [{"operation": "Index lookup on r%K using i%N (c%W = %N)", "table_name": "r%K", "index_name": "i%N", "lookup_condition": "c%W = %N", "schema_name": "s%N", "sort_key": "s%N.r%K.k%W", "estimated_rows": %N}]\n}',
    ("select %K", "str1"), ("r%K", "table2"), ("i%N", "idx3"), ("c%W = %N", "str4"), ("s%N", "schema5"), ("k%W", "col6"),
)
_rewrites(
    "plan_parse_mysql_v1",
    '{\n  "query_block": {\n    "select_id": 1,\n    "cost_info": {"query_cost": "%N.00"},\n    "nested_loop": [{"table": {"table_name": "r%K", "access_type": "ref", "possible_keys": ["i%N"], "key": "i%N", "key_length": "%N", "ref": ["x.%W"], "used_columns": ["c%N", "d%W"], "attached_condition": "(y = %K)"}}]\n  }\n}',
    ("r%K", "table1"), ("i%N", "idx2"), ("x.%W", "str3"), ("c%N", "col4"), ("d%W", "col5"), ("(y = %K)", "str6"),
)
_rewrites(
    "plan_parse_sqlserver",
    "StmtText\n  |--Index Seek(OBJECT:([d%N].[s%W].[r%K].[i%N] AS [a%N]), SEEK:([a%N].[c%W]='v%K'), ROWS:(%N))",
    ("d%N", "schema1"), ("s%W", "schema2"), ("r%K", "table3"), ("i%N", "idx4"), ("a%N", "table5"), ("c%W", "col6"), ("v%K", "str7"),
)
_rewrites(
    "plan_parse_showplan_xml",
    '<ShowPlanXML xmlns="http://schemas.microsoft.com/sqlserver/2004/07/showplan" Version="1.%N"><BatchSequence><Batch><Statements><StmtSimple StatementText="select %K" StatementId="%N" StatementType="SELECT"><QueryPlan><RelOp NodeId="0" PhysicalOp="Table Scan" EstimateRows="%N">'
    '<OutputList><ColumnReference Table="[r%K]" Alias="[a%N]" Column="c%W"/><ColumnReference Column="Expr%N"/></OutputList><TableScan Ordered="0"><Object Database="[d%W]" Table="[r%K]" Alias="[a%N]"/><Predicate><ScalarOperator ScalarString="[a%N].[c%W]=\'v%K\'"/></Predicate></TableScan></RelOp></QueryPlan></StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>',
    ("select %K", "str1"), ("r%K", "table2"), ("a%N", "table3"), ("c%W", "col4"), ("Expr%N", "str5"), ("d%W", "schema6"), ("v%K", "str7"),
)
_rewrites(
    "plan_parse_monitor_xml",
    '<report db_version="19.%N"><sql_monitor_report status="DONE" user="U%W"><sql_fulltext><![CDATA[select %K]]></sql_fulltext><binds><bind name=":B%N" dty="1" dtystr="VARCHAR2(%N)" maxlen="%N">v%K</bind><bind dty="2">%N</bind></binds>'
    '<plan><operation id="1" name="INDEX" options="RANGE SCAN" cost="%N"><object type="INDEX"><owner>O%N</owner><name>I%K</name></object></operation></plan></sql_monitor_report></report>',
    ("U%W", "str1"), ("select %K", "str2"), (":B%N", "str3"), ("(%N)", ""), (' maxlen="%N"', ""), ("v%K", "str4"), ("O%N", "schema5"), ("I%K", "idx6"),
)
_rewrites(
    "plan_parse_oracle",
    "| Id  | Operation | Name | Rows |\n|   1 | TABLE ACCESS FULL | R%K | %N |\n|   2 | INDEX RANGE SCAN | I%N | %N |\nPredicate Information (identified by operation id):\n   1 - filter(\"A\".\"C%N\"='v%K' AND UPPER(\"D\")=:B%N)",
    ("R%K", "table1"), ("I%N", "idx2"), ('"A"', '"table3"'), ("C%N", "col4"), ("v%K", "str5"), ('"D"', '"col6"'), ("B%N", "col7"),
)
_rewrites(
    "plan_outline_hints",
    '| Id  | Operation | Name |\n|   1 | TABLE ACCESS FULL | R%K |\nOutline Data\n  /*+\n      BEGIN_OUTLINE_DATA\n      INDEX(@"SEL$%N" "A%N"@"SEL$%N" ("R%K"."C%N"))\n      DB_VERSION(\'19.%N\')\n      OPT_PARAM(\'p%K\' %N)\n      MINE(%K)\n  */',
    ("A%N", "table2"), ('"R%K"', '"table3"'), ("R%K", "table1"), ("C%N", "col4"), ("p%K", "str5"), ("MINE(%K)", "str6"),
)
_rewrites(
    "plan_framed_psql",
    " QUERY PLAN\n----------------------\n Seq Scan on r%K  (cost=0.00..%N rows=1 width=4)\n   Filter: (c%W = %N)\n(2 rows)\n",
    ("r%K", "table1"), ("c%W", "col2"),
)
_rewrites(
    "plan_framed_unicode",
    " QUERY PLAN\n──────────────────────\n [                   ↵\n   {\"Plan\": {\"Alias\": \"a%K\"}} ↵\n ]\n(1 row)\n",
    ("a%K", "table1"),
)
_rewrites(
    "plan_framed_vertical",
    '*************************** 1. row ***************************\nEXPLAIN: {\n  "query": "select %K",\n  "inputs": [{"operation": "Table scan on r%K", "table_name": "r%K"}]\n}\n1 row in set (0.0%N sec)\n',
    ("select %K", "str1"), ("r%K", "table2"),
)
_rewrites(
    "plan_settings",
    '[ {"Plan": {"Node Type": "Result"}, "Settings": {"search_path": "s%W, \\"$user\\", t%K", "work_mem": "%NMB", "app.%W": "v%K"}, "Query Parameters": "$1 = \'x%K\', $2 = %N, $3 = NULL"} ]',
    ("s%W", "schema1"), ("t%K", "schema2"), ("app.%W", "str3"), ("v%K", "str4"), ("x%K", "str5"),
)
_rewrites(
    "plan_declarations",
    "CTE Scan on w%K  (cost=0.00..%N rows=1 width=4)\n  Filter: ((w%K.c%N)::timestamp with time zone > (SubPlan 1))\n  CTE w%K\n    ->  Result  (cost=0.00..0.01 rows=1 width=4)\n          Output: \"C %N\", x%W.y.z, 'it''s'::text\n  SubPlan 1\n    ->  Seq Scan on only r%K  (cost=0.00..1.00 rows=1 width=4)\nQuery Parameters: $1 = 'v%K', $2 = f(%N)",
    ("w%K", "table1"), ("c%N", "col2"), ("C %N", "col3"), ("x%W.y.z", "schema4.table5.col6"), ("it''s", "str7"), ("only r%K", "table8 table9"), ("v%K", "str10"), ("f(%N)", "str11"),
)

# Heads of every format of the catalogue, of two that none accepts, and of one that two accept.
HEADS = r"""
SELECT p_partkey AS doc_id, CASE p_partkey % 19
  WHEN 0 THEN concat('Hash Join  (cost=0.0..', p_size, ')') WHEN 1 THEN concat(' [', p_size) WHEN 2 THEN concat('- Plan: ', p_size) WHEN 3 THEN concat('<explain a="', p_size, '">')
  WHEN 4 THEN concat('{', chr(10), ' "query": "', p_name, '"') WHEN 5 THEN concat('{', chr(10), '  "query_block": {', chr(10), '    "select_id": ', p_size, ',', chr(10), '    "message": "x"')
  WHEN 6 THEN concat('-> Limit: ', p_size) WHEN 7 THEN concat('+--+', chr(10), '| Level | Code | Message |', chr(10), '+--+', chr(10), p_size)
  WHEN 8 THEN concat('{', chr(10), '  "query_block": {', chr(10), '    "select_id": ', p_size, ',', chr(10), '    "r_loops": 1')
  WHEN 9 THEN concat('| id | select_type | table | type | possible_keys | key | key_len | ref | rows | Extra |', chr(10), p_size)
  WHEN 10 THEN concat('<ShowPlanXML Version="', p_size, '"/>') WHEN 11 THEN concat('StmtText', chr(10), '  |--Top(', p_size, ')')
  WHEN 12 THEN concat(replace('StmtText StmtId NodeId Parent PhysicalOp LogicalOp Argument DefinedValues EstimateRows EstimateIO EstimateCPU AvgRowSize TotalSubtreeCost OutputList Warnings Type Parallel EstimateExecutions', ' ', chr(9)), chr(10), p_size)
  WHEN 13 THEN concat(replace('Rows Executes StmtText StmtId NodeId Parent PhysicalOp LogicalOp Argument DefinedValues EstimateRows EstimateIO EstimateCPU AvgRowSize TotalSubtreeCost OutputList Warnings Type Parallel EstimateExecutions', ' ', chr(9)), chr(10), p_size)
  WHEN 14 THEN concat('-----', chr(10), '| Id | Operation | Name |', chr(10), p_size) WHEN 15 THEN concat('<report db_version="', p_size, '">')
  WHEN 16 THEN p_name WHEN 17 THEN concat('{', chr(10), '  "query_block": {', chr(10), '    "select_id": ', p_size, ',', chr(10), '    "table": {') ELSE concat('<report', p_size, '>') END AS text
FROM part"""
_FORM = "CASE format " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in formats.FORMS.items()) + " END"
_RECOURSE = "CASE format " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in formats.FORMS.items() if v[1]) + " END"


@query(f"""SELECT doc_id, format, CASE WHEN format IS NULL THEN 'unreadable' WHEN {_FORM} IS NOT NULL THEN 'refused' ELSE 'recognised' END AS status, {_FORM} AS form, {_RECOURSE} AS recourse FROM (
  SELECT doc_id, CASE WHEN text LIKE '%Join  (cost=%' THEN 'text' WHEN text LIKE ' [%' THEN 'json' WHEN text LIKE '- %:%' THEN 'yaml' WHEN text LIKE '<explain %' THEN 'xml' WHEN text LIKE '%"query": %' THEN 'mysql-json-v2' WHEN text LIKE '%"message"%' THEN 'mysql-json-v1'
    WHEN text LIKE '-> %' THEN 'mysql-tree' WHEN text LIKE '%| Level |%' THEN 'mysql-tabular' WHEN text LIKE '%"r_loops"%' THEN 'mariadb-json' WHEN text LIKE '| id |%' THEN 'mariadb-tabular' WHEN text LIKE '<ShowPlanXML %' THEN 'sqlserver-showplan-xml' WHEN text LIKE 'StmtText%|--%' THEN 'sqlserver-showplan-text'
    WHEN text LIKE 'StmtText%StmtId%' THEN 'sqlserver-showplan-all' WHEN text LIKE 'Rows%' THEN 'sqlserver-statistics-profile' WHEN text LIKE '-----%' THEN 'oracle-grid-text' WHEN text LIKE '<report %' THEN 'oracle-sql-monitor-xml' END AS format FROM ({duck(HEADS)}))""")
def format_heads(spark: SparkSession, d: str) -> DataFrame:
    return formats.readings(read(spark, d, HEADS)).drop("text")


# Plans of which some fields cannot be scanned, some rows refuse, and names repeat.
FIELDS = """SELECT p_partkey AS doc_id, concat('Seq Scan on t', p_size % 4, '  (cost=0.00..1.00 rows=1 width=4)', chr(10), CASE p_partkey % 4 WHEN 0 THEN concat('  Filter: (a = ''x', p_size) WHEN 1 THEN concat('  Filter: (lower(b) = ''', p_size, '''::text)') WHEN 2 THEN concat('Settings: x = ', p_size) ELSE concat('  Filter: ((a = b) AND (a = ', p_size, '))') END) AS text FROM part"""


@query(f"SELECT 'text' AS format, count(*) FILTER (doc_id % 4 = 0) AS captures, CAST(sum(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 3 THEN 5 END) AS BIGINT) AS fields, count(*) FILTER (doc_id % 4 = 0) AS unscannable FROM ({duck(FIELDS)})")
def redaction_rate(spark: SparkSession, d: str) -> DataFrame:
    return reports.redaction_rate(parse.parse_plans(read(spark, d, FIELDS)).where("status = 'read'"))


@query(f"SELECT spelling, count(*) AS n FROM (SELECT unnest(CASE doc_id % 4 WHEN 1 THEN ['lower', 'text'] WHEN 3 THEN ['AND'] END) AS spelling FROM ({duck(FIELDS)})) GROUP BY spelling")
def preserve_counts(spark: SparkSession, d: str) -> DataFrame:
    plans = parse.read_plans(read(spark, d, FIELDS)).where("status = 'read'").select("text", F.explode("spans").alias("s"))
    return reports.preserve_counts(plans.select("s.disposition", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("spelling")))


@query(f"SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS BIGINT) AS replaced, CAST(CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS preserved FROM ({duck(FIELDS)}) WHERE doc_id % 4 <> 2")
def plan_name_counts(spark: SparkSession, d: str) -> DataFrame:
    return parse.plan_counts(read(spark, d, FIELDS))


CAPTURES = f"SELECT doc_id, text, CASE WHEN doc_id % 4 = 2 THEN CASE WHEN doc_id % 8 = 2 THEN 'refusal-postgres-text-raw-name-row' ELSE 'text' END WHEN doc_id % 8 = 1 THEN 'refusal-mysql-tree' ELSE 'text' END AS label FROM ({FIELDS}) f"


@query(f"SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN label = 'text' THEN CASE WHEN text LIKE '%Settings:%' THEN 'refused_admitted' ELSE 'right' END WHEN text NOT LIKE '%Settings:%' THEN 'read_refused' ELSE 'right' END AS verdict FROM ({duck(CAPTURES)})) GROUP BY verdict")
def capture_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return reports.capture_verdicts(parse.read_plans(read(spark, d, CAPTURES)))


UNIVERSE = """SELECT p_partkey AS doc_id, concat('Seq Scan on "', split_part(p_name, ' ', 1), '' || p_size, '" a', p_size, chr(10), '  Filter: (k', p_size, ' IS NOT NULL AND [x.y', p_size, '] > ', p_size, 'kB)') AS text FROM part"""


@query(f"""SELECT doc_id, spelling, delimited FROM (SELECT doc_id, unnest([concat(w, n), concat('a', n), concat('k', n), 'x', concat('y', n), concat('x.y', n), 'Seq', 'Scan', 'on', 'Filter']) AS spelling, unnest([true, false, false, true, true, true, false, false, false, false]) AS delimited
  FROM (SELECT p_partkey AS doc_id, split_part(p_name, ' ', 1) AS w, CAST(p_size AS VARCHAR) AS n FROM part))""")
def plan_universe(spark: SparkSession, d: str) -> DataFrame:
    return leaks.plan_universe(read(spark, d, UNIVERSE), "PostgreSQL")


@query("SELECT p_partkey AS doc_id, concat('k', p_size) AS spelling, false AS delimited, 2 AS line FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'x', true, 3 FROM part")
def plan_survivors(spark: SparkSession, d: str) -> DataFrame:
    outputs = read(spark, d, "SELECT p_partkey AS doc_id, concat('Result', chr(10), CASE WHEN p_size % 2 = 0 THEN concat('k', p_size) ELSE 'col1' END, chr(10), '\"x\"') AS text FROM part")
    return leaks.plan_survivors(leaks.plan_universe(read(spark, d, UNIVERSE), "PostgreSQL"), outputs)


#: Labels of each scope, counted over the engines' own inventories.
_COUNTS = "query 11 buffers 22 plan 119 trigger 6 jit 4 options 4 timing 5 sort 4 space 2 mysql2 3 mysql2_node 28 mysql1 1 mysql1_block 17 mysql1_union 4 mysql1_table 21 mysql1_cost 6 showplan 6 statement 17 set_options 7 query_plan 15 memory_grant 8 column 9 scalar 9 convert 7 rel_op 26 index_scan 12 table_scan 8 object 9 nested_loops 7 hash 6 top 7 report 4 monitor 14 bind 8 operation_row 9".split()
_SCOPES = list(zip(_COUNTS[::2], map(int, _COUNTS[1::2]), strict=True))


@query("SELECT scope, CAST(labels AS BIGINT) AS labels FROM (VALUES " + ", ".join(f"('{k}', {n})" for k, n in _SCOPES) + ") v(scope, labels)")
def inventory_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = [(scope, label, str(kind)) for scope, fields in structured.FIELDS.items() for label, kind in fields.items()]
    counts = spark.createDataFrame(rows, "scope string, label string, treatment string").groupBy("scope").agg(F.count("*").alias("labels"))
    return counts.where(F.col("scope").isin([k for k, _ in _SCOPES]))
