"""Queries over the supplied tables, each with SQL that makes the same rows.

The tables hold no plans, traces or placeholders, so inputs are made from their columns by SQL that both engines run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import allocation, formats, policy, reports, reversal, state, traces
from .plans import parse
from .registry import ALL, SQL, duck, made, query, read  # noqa: F401

# Inputs, in SQL common to Spark and DuckDB.
PACKAGES = "SELECT p_partkey AS id, concat('com.', lower(replace(p_brand, '#', 'n')), '.', lower(replace(p_type, ' ', '.'))) AS package FROM part"
INTERNAL = "SELECT DISTINCT concat('com.', lower(replace(p_brand, '#', 'n'))) AS prefix FROM part WHERE p_size > 25"
THIRD = "SELECT DISTINCT concat('com.', lower(replace(p_brand, '#', 'n')), '.', lower(split_part(p_type, ' ', 1))) AS prefix FROM part WHERE p_size < 10"
EVIDENCE = """
SELECT c_custkey % 100 AS doc_id, concat('class:a.C', CAST(c_nationkey AS STRING), '#m', CAST(c_custkey % 7 AS STRING)) AS shared,
  CASE c_custkey % 4 WHEN 0 THEN 'IN_CONTENT' WHEN 1 THEN 'LIBRARY' WHEN 2 THEN 'JDK' ELSE 'UNRESOLVED' END AS origin,
  CASE WHEN c_custkey % 3 = 0 THEN 'METHOD' ELSE 'FIELD' END AS role,
  CASE WHEN c_custkey % 11 = 0 THEN 'main' ELSE concat('m', CAST(c_custkey % 7 AS STRING)) END AS declared_name,
  c_custkey % 4 = 0 AS owned, c_custkey % 13 <> 0 AS roots_owned, c_custkey % 4 IN (0, 3) AS would_replace, c_custkey % 17 = 0 AS ticked, c_custkey % 5 = 0 AS in_comment
FROM customer"""
PLANS = """
SELECT p_partkey AS doc_id, CASE
  WHEN p_partkey % 9 = 0 THEN concat('[', chr(10), '  {"Plan": {}}', chr(10), ']')
  WHEN p_partkey % 9 = 1 THEN concat('- Plan: ', chr(10), '    Node Type: x')
  WHEN p_partkey % 9 = 2 THEN '<explain xmlns="x">'
  WHEN p_partkey % 9 = 3 THEN concat('Seq Scan on ', lower(split_part(p_name, ' ', 1)), p_partkey, 'x  (cost=0.00..', p_size, '.00 rows=1 width=4)')
  WHEN p_partkey % 9 = 4 THEN concat('Index Scan using k', p_size, 'k on s', p_partkey, 's.t', p_size, 't a  (cost=0.00..1.00 rows=1 width=4)', chr(10), '  Filter: (a.c', p_size, 'c = ', p_size, ')')
  WHEN p_partkey % 9 = 5 THEN '-> Table scan'
  WHEN p_partkey % 9 = 6 THEN '<ShowPlanXML Version="1.5">'
  WHEN p_partkey % 9 = 7 THEN concat('Plan hash value: ', p_partkey)
  ELSE p_name END AS text
FROM part"""
TRACES = """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 5
  WHEN 0 THEN concat('com.acme.Fault', CAST(o_custkey AS STRING), ': order ', CAST(o_orderkey AS STRING), chr(10), chr(9), 'at app//com.acme.Orders$Line.total(Orders.java:', CAST(o_orderkey % 90 + 1 AS STRING), ')', chr(10), chr(9), '... 3 more', chr(10))
  WHEN 1 THEN concat('Exception in thread "w', CAST(o_custkey AS STRING), '" com.acme.Fault', chr(10), chr(9), 'at com.acme.Main.<init>(Native Method)', chr(10), 'Caused by: a.B: x', chr(10), chr(9), 'at a.B.run(Unknown Source)')
  WHEN 2 THEN concat('com.acme.Fault: no frame ', o_orderpriority)
  WHEN 3 THEN concat('Coroutines dump ', CAST(o_orderkey AS STRING))
  ELSE concat(o_orderpriority, ' is no trace') END AS text
FROM orders"""
REPLIES = "SELECT CAST(user_id AS STRING) AS project_id, event_id AS doc_id, concat('Use Type', CAST(event_id % 40 AS STRING), ' and getField', CAST(event_id % 25 AS STRING), ', then str', CAST(event_id % 9 AS STRING), ' in ', event_type, '.') AS text FROM events"
LEDGER = "SELECT DISTINCT CAST(user_id AS STRING) AS project_id, concat('Type', CAST(event_id % 30 AS STRING)) AS placeholder, concat('Order', CAST(event_id % 30 AS STRING)) AS original, concat('class:', CAST(event_id % 30 AS STRING)) AS key FROM events WHERE event_id % 2 = 0"
RUNS_ = "SELECT CAST(user_id AS STRING) AS project_id, event_id AS seq, ts AS seen, concat('field', CAST(event_id % 20 AS STRING)) AS placeholder, concat(event_type, CAST(event_id % 50 AS STRING)) AS original FROM events WHERE event_id % 3 = 0"
HEADS = "SELECT DISTINCT CAST(user_id AS STRING) AS project_id, 20 AS next_number FROM events"
NAMES = "SELECT c_nationkey AS doc_id, CAST(c_custkey AS INT) AS ordinal, concat(c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN ', \"x\"' ELSE '' END) AS original, CASE WHEN c_custkey % 4 <> 0 THEN concat('Type', CAST(c_custkey AS STRING)) END AS placeholder, CASE WHEN c_custkey % 6 = 0 THEN 'LITERAL' ELSE 'TYPE' END AS kind, c_custkey % 10 = 0 AS remainder FROM customer"
STEMS = "SELECT DISTINCT word AS stem FROM (SELECT explode(split(concat(p_name, ' ', p_brand, ' ', p_type, ' Type str getField my$x a', CAST(p_size AS STRING), ' _ok ', p_size), ' ')) AS word FROM part)"


@query(r"SELECT doc_id, len(w) AS n_tiles, len(list_filter(w, lambda x: regexp_matches(x, '^[\p{L}\p{N}_]'))) AS n_words, array_to_string(w, '') = text AS lossless FROM (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS w FROM documents)")
def word_tiles(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "SELECT doc_id, text FROM documents").withColumn("w", X.tiles(F.col("text")))
    words = F.filter("w", lambda x: x.rlike(r"^[\p{L}\p{N}_]"))
    return t.select("doc_id", F.size("w").cast("long").alias("n_tiles"), F.size(words).cast("long").alias("n_words"), (F.array_join("w", "") == F.col("text")).alias("lossless"))


@query(r"SELECT doc_id, len(w) AS n, md5(array_to_string(list_sort(w), ' ')) AS digest FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '[\p{L}_][\p{L}\p{N}_]*')) AS w FROM documents)")
def reserved_words(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "SELECT doc_id, text FROM documents").withColumn("w", X.reserved_words(F.col("text")))
    return t.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


_OCCURRENCES = "SELECT user_id AS doc_id, CAST(event_id AS INT) AS start, CAST(event_type AS STRING) AS key, 'str' AS namespace, CAST(event_type AS STRING) AS original FROM events"


@query(f"SELECT doc_id, key, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY start) AS INT) AS number, concat(namespace, dense_rank() OVER (PARTITION BY doc_id ORDER BY start)) AS placeholder FROM (SELECT doc_id, key, namespace, min(start) AS start FROM ({duck(_OCCURRENCES)}) GROUP BY ALL)")
def shared_mask_keys(spark: SparkSession, d: str) -> DataFrame:
    return allocation.number_fast(read(spark, d, _OCCURRENCES)).select("doc_id", "key", "number", "placeholder")


@query(r"""SELECT doc_id, word, CAST(6 + dense_rank() OVER (PARTITION BY doc_id ORDER BY first_at) AS INT) AS number FROM (SELECT doc_id, word, min(i) AS first_at FROM (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}_][\p{L}\p{N}_]*') AS w FROM documents)) GROUP BY ALL)""")
def first_occurrence_numbering(spark: SparkSession, d: str) -> DataFrame:
    numbered = read(spark, d, "SELECT doc_id, text FROM documents").select("doc_id", F.explode(allocation.number_words(X.names(F.col("text")), "Type", 7)).alias("n"))
    return numbered.select("doc_id", F.col("n.key").alias("word"), F.col("n.number").cast("int").alias("number"))


_BURN = "SELECT user_id AS doc_id, concat('Type', CAST(event_id % 6 + 1 AS STRING)) AS word FROM events WHERE event_id % 4 = 0"


@query(f"""WITH RECURSIVE k AS (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY min(start), key) AS r FROM ({duck(_OCCURRENCES)}) GROUP BY doc_id, key),
taken AS (SELECT DISTINCT doc_id, CAST(substr(word, 5) AS INT) AS n FROM ({duck(_BURN)})),
free AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM (SELECT DISTINCT doc_id, unnest(range(1, 60)) AS n FROM k) f WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.doc_id = f.doc_id AND t.n = f.n))
SELECT doc_id, key, CAST(n AS INT) AS number, concat('Type', n) AS placeholder FROM k JOIN free USING (doc_id, r)""")
def burnt_numbers(spark: SparkSession, d: str) -> DataFrame:
    occurrences = read(spark, d, _OCCURRENCES).withColumn("namespace", F.lit("Type"))
    return allocation.number(occurrences, read(spark, d, _BURN), ["Type"]).select("doc_id", "key", "number", "placeholder")


@query(f"""SELECT id, package, coalesce((SELECT max(length(prefix)) FROM ({duck(INTERNAL)}) i WHERE package = prefix OR starts_with(package, concat(prefix, '.'))), -1)
  > coalesce((SELECT max(length(prefix)) FROM ({duck(THIRD)}) t WHERE package = prefix OR starts_with(package, concat(prefix, '.'))), -1) AS claimed FROM ({duck(PACKAGES)})""")
def longest_prefix_ownership(spark: SparkSession, d: str) -> DataFrame:
    return policy.claimed_packages(read(spark, d, PACKAGES), read(spark, d, INTERNAL), read(spark, d, THIRD))


@query(f"SELECT id, package, CASE WHEN contains(package, '.') THEN concat(split_part(package, '.', 1), '.', split_part(package, '.', 2)) ELSE package END AS root, NOT contains(package, '.') AS top FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'com' ELSE package END AS package FROM ({duck(PACKAGES)}))")
def top_level_segment(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, PACKAGES).withColumn("package", F.when(F.col("id") % 3 == 0, "com").otherwise(F.col("package")))
    kept = policy.is_anonymized(F.lit("IN_CONTENT"), F.lit(False), F.lit("PACKAGE"), F.col("package"))
    return p.select("id", "package", X.root_package(F.col("package")).alias("root"), (~kept).alias("top"))


_ROOTS = "SELECT l_orderkey, concat('method:', CAST(l_partkey AS STRING), '#', l_returnflag) AS key, l_quantity > 25 AS qualified FROM lineitem"


@query(f"SELECT l_orderkey, min(key) AS shared, arg_min(qualified, key) AS q FROM (SELECT l_orderkey, key, bool_and(qualified) AS qualified FROM ({duck(_ROOTS)}) GROUP BY ALL) GROUP BY l_orderkey")
def shared_override_key(spark: SparkSession, d: str) -> DataFrame:
    roots = read(spark, d, _ROOTS).groupBy("l_orderkey").agg(F.collect_list(F.struct("key", "qualified")).alias("roots"))
    return roots.select("l_orderkey", policy.shared_key(F.lit("own"), F.col("roots")).alias("shared"), policy.shared_key_qualified(F.lit(False), F.col("roots")).alias("q"))


@query(f"SELECT DISTINCT shared FROM ({duck(EVIDENCE)}) WHERE owned AND (NOT roots_owned OR (role = 'METHOD' AND declared_name IN ('main', 'readObject', 'writeObject', 'readResolve', 'writeReplace')))")
def name_constrained_closure(spark: SparkSession, d: str) -> DataFrame:
    return policy.constrained_keys(read(spark, d, EVIDENCE))


_OUTCOMES = f"""WITH e AS ({duck(EVIDENCE)}), c AS (SELECT DISTINCT shared FROM e WHERE owned AND (NOT roots_owned OR (role = 'METHOD' AND declared_name = 'main'))),
g AS (SELECT doc_id, shared, bool_or(origin = 'UNRESOLVED') AS u, bool_or(would_replace AND NOT ticked AND shared NOT IN (SELECT shared FROM c)) AS r, bool_and(in_comment) AS oc FROM e GROUP BY ALL)
SELECT doc_id, count(*) FILTER (r AND NOT u) AS replaced, count(*) FILTER (u) AS unknown, count(*) FILTER (NOT r AND NOT u) AS preserved, count(*) FILTER (u AND oc) AS unknown_from_comments FROM g GROUP BY doc_id"""


@query(_OUTCOMES)
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.name_counts(policy.outcomes(read(spark, d, EVIDENCE)))


@query(f"SELECT doc_id, original, list(placeholder ORDER BY ordinal) AS placeholders FROM ({duck(NAMES)}) WHERE placeholder IS NOT NULL AND kind <> 'LITERAL' AND NOT remainder GROUP BY ALL HAVING count(*) > 1")
def flattened_names(spark: SparkSession, d: str) -> DataFrame:
    return reports.flattened(read(spark, d, NAMES))


@query(f"SELECT project_id, seq, placeholder FROM ({duck(RUNS_)}) r JOIN (SELECT project_id, max(seen) AS now FROM ({duck(RUNS_)}) GROUP BY ALL) USING (project_id) WHERE seen >= now - INTERVAL 30 DAY QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY seen DESC, seq DESC) <= 50")
def sidecar_window(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, RUNS_).withColumnRenamed("seen", "at")
    now = runs.groupBy("project_id").agg(F.max("at").alias("now"))
    return state.bounded(runs.join(now, "project_id"), F.col("now")).select("project_id", "seq", "placeholder")


@query(f"SELECT project_id, placeholder, arg_max(original, seq) AS original FROM ({duck(RUNS_)}) GROUP BY ALL")
def newest_run_lookup(spark: SparkSession, d: str) -> DataFrame:
    return reversal.newest_runs(read(spark, d, RUNS_))


_DELTA = LEDGER.replace("event_id % 2 = 0", "event_id % 3 = 0").replace("concat('Order'", "concat('New'")


@query(f"SELECT project_id, key, placeholder, arg_min(original, age) AS original FROM (SELECT *, 0 AS age FROM ({duck(LEDGER)}) UNION ALL SELECT *, 1 FROM ({duck(_DELTA)})) GROUP BY ALL")
def ledger_commit(spark: SparkSession, d: str) -> DataFrame:
    return state.commit(read(spark, d, LEDGER), read(spark, d, _DELTA))


_KNOWN = f"""k AS (SELECT project_id, placeholder, arg_min(original, rank) AS original FROM (SELECT project_id, placeholder, arg_max(original, seq) AS original, 0 AS rank FROM ({duck(RUNS_)}) GROUP BY ALL
  UNION ALL SELECT project_id, placeholder, original, 1 FROM ({duck(LEDGER)})) GROUP BY ALL),
t AS (SELECT project_id, doc_id, text, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')) AS word, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), 1) AS i FROM ({duck(REPLIES)})),
j AS (SELECT t.*, k.original, u.original IS NOT NULL AS unsent FROM t LEFT JOIN k ON k.project_id = t.project_id AND k.placeholder = word
  LEFT JOIN k u ON u.project_id = t.project_id AND word LIKE 'getField%' AND u.placeholder = concat('field', substr(word, 9)))"""


def _reversed(spark: SparkSession, d: str) -> DataFrame:
    heads = read(spark, d, HEADS).withColumn("stems", F.array().cast("array<string>"))
    return reversal.deanonymize(read(spark, d, REPLIES), read(spark, d, RUNS_), read(spark, d, LEDGER), heads)


@query(f"WITH {_KNOWN} SELECT project_id, doc_id, string_agg(coalesce(original, word), '' ORDER BY i) AS text FROM j GROUP BY ALL")
def restore_reply(spark: SparkSession, d: str) -> DataFrame:
    return _reversed(spark, d).select("project_id", "doc_id", "text")


@query(rf"""WITH {_KNOWN} SELECT doc_id, word AS placeholder, CASE WHEN unsent THEN 'UNSENT_SPELLING' WHEN CAST(regexp_extract(word, '\d+$') AS INT) < 20 THEN 'EVICTED' ELSE 'FOREIGN' END AS reason
FROM j WHERE original IS NULL AND (unsent OR regexp_matches(word, '^(Type|str|getField)\d+$'))""")
def unrestored_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _reversed(spark, d).select("doc_id", F.explode("unrestored").alias("u")).select("doc_id", "u.*")


@query(f"""SELECT stem, CASE WHEN stem = '' THEN NULL WHEN NOT regexp_matches(stem, '^[A-Za-z_$][A-Za-z0-9_$]*$') THEN 'NOT_AN_IDENTIFIER' WHEN contains(stem, '$') THEN 'CARRIES_A_DOLLAR'
  WHEN regexp_matches(stem, '[0-9]$') THEN 'ENDS_WITH_A_DIGIT' WHEN stem IN ('Type', 'str', 'getField') THEN 'RESERVED_NAMESPACE' END AS rejection FROM ({duck(STEMS)})""")
def stem_validity(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, STEMS).withColumn("rejection", X.stem_rejection(F.col("stem")))


@query("SELECT p_partkey, concat('get', upper(substr(w, 1, 1)), substr(w, 2)) AS getter, regexp_replace(concat(w, p_size), '[0-9]+$', '') AS stem, CAST(p_size AS VARCHAR) AS number FROM (SELECT p_partkey, p_size, split_part(p_name, ' ', 1) AS w FROM part)")
def accessor_derivation(spark: SparkSession, d: str) -> DataFrame:
    w = F.split_part("p_name", F.lit(" "), F.lit(1))
    word = F.concat(w, F.col("p_size").cast("string"))
    return read(spark, d, "SELECT * FROM part").select("p_partkey", X.accessor(F.lit("get"), w).alias("getter"), X.stem_of(word).alias("stem"), X.number_of(word).alias("number"))


@query(f"SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'json' WHEN 1 THEN 'yaml' WHEN 2 THEN 'xml' WHEN 3 THEN 'text' WHEN 4 THEN 'text' WHEN 5 THEN 'mysql-tree' WHEN 6 THEN 'sqlserver-showplan-xml' WHEN 7 THEN 'oracle-grid-text' END AS format, CASE doc_id % 9 WHEN 5 THEN 'refused' WHEN 8 THEN 'unreadable' ELSE 'recognised' END AS status, CASE doc_id % 9 WHEN 5 THEN 'MYSQL_TREE' END AS form, CASE doc_id % 9 WHEN 5 THEN 'MYSQL_FORMAT_JSON' END AS recourse FROM ({duck(PLANS)})")
def format_recognition(spark: SparkSession, d: str) -> DataFrame:
    return formats.readings(read(spark, d, PLANS)).drop("text")


@query(rf"""SELECT doc_id, CASE WHEN text LIKE '[%' THEN text WHEN text LIKE '- Plan%' THEN text WHEN text LIKE 'Seq Scan%' THEN regexp_replace(text, '^Seq Scan on \S+', 'Seq Scan on table1')
  WHEN text LIKE 'Index Scan%' THEN concat(regexp_replace(split_part(text, chr(10), 1), '^Index Scan using \S+ on [^.]+[.]\S+ a', 'Index Scan using idx1 on schema2.table3 table4'), chr(10), regexp_replace(split_part(text, chr(10), 2), 'a[.]c\d+c', 'table4.col5')) END AS text
FROM ({duck(PLANS)})""")
def pg_text_names(spark: SparkSession, d: str) -> DataFrame:
    return parse.read_plans(read(spark, d, PLANS)).select("doc_id", F.col("anonymized").alias("text"))


@query(rf"""SELECT doc_id, CASE WHEN text LIKE '[%' THEN 'json' WHEN text LIKE '- Plan%' THEN 'yaml' WHEN text LIKE '<explain%' THEN 'xml' WHEN text LIKE 'Seq Scan%(cost=%' OR text LIKE 'Index Scan%(cost=%' THEN 'text'
  WHEN text LIKE '-> %' THEN 'mysql-tree' WHEN text LIKE '<ShowPlanXML%' THEN 'sqlserver-showplan-xml' WHEN text LIKE 'Plan hash value: %' THEN 'oracle-grid-text' END AS format,
  CASE WHEN text LIKE '[%' OR text LIKE '- Plan%' OR text LIKE '%(cost=%' THEN 'read' WHEN text LIKE '-> %' THEN 'refused' ELSE 'unreadable' END AS status,
  CASE WHEN text LIKE '-> %' THEN 'MYSQL_TREE' END AS form, CASE WHEN text LIKE '-> %' THEN 'MYSQL_FORMAT_JSON' END AS recourse FROM ({duck(PLANS)})""")
def plan_statuses(spark: SparkSession, d: str) -> DataFrame:
    return parse.read_plans(read(spark, d, PLANS)).select("doc_id", "format", "status", "form", "recourse")


@query(rf"""SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'coroutine_dump' WHEN 0 THEN 'read' WHEN 1 THEN 'read' ELSE 'not_a_trace' END AS status,
  CASE doc_id % 5 WHEN 0 THEN regexp_extract(text, '^[^:]+') WHEN 1 THEN 'com.acme.Fault,a.B' END AS exceptions,
  CASE doc_id % 5 WHEN 0 THEN 'com.acme.Orders$Line.total@Orders.java' WHEN 1 THEN 'com.acme.Main.-@-,a.B.run@-' END AS frames,
  CASE doc_id % 5 WHEN 0 THEN regexp_extract(text, ': ([^\n]*)', 1) WHEN 1 THEN concat(regexp_extract(text, '"(.*?)"', 1), ',x') END AS texts,
  CASE doc_id % 5 WHEN 0 THEN rtrim(replace(text, 'app//', ''), chr(10)) WHEN 1 THEN text END AS stripped FROM ({duck(TRACES)})""")
def trace_lines(spark: SparkSession, d: str) -> DataFrame:
    t = traces.parse_traces(read(spark, d, TRACES))
    frames = F.array_join(F.transform("frames", lambda f: F.concat(f["type"], F.lit("."), F.coalesce(f["method"], F.lit("-")), F.lit("@"), F.coalesce(f["file"], F.lit("-")))), ",")
    return t.select("doc_id", "status", F.array_join("exceptions", ",").alias("exceptions"), frames.alias("frames"), F.array_join("texts", ",").alias("texts"), "stripped")


_RANGES = "SELECT l_orderkey AS doc_id, CAST(l_partkey % 1000 AS INT) AS start, CAST(l_partkey % 1000 + l_quantity * 3 AS INT) AS end_ FROM lineitem"


@query(f"""SELECT doc_id, min(start) AS start, max(end_) AS "end" FROM (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, max(end_) OVER (PARTITION BY doc_id ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({duck(_RANGES)}))) GROUP BY doc_id, g""")
def fragment_merge(spark: SparkSession, d: str) -> DataFrame:
    # SQL rounds to the even number where Spark's cast cuts off
    ranges = _RANGES.replace("l_partkey % 1000 + l_quantity * 3", "rint(l_partkey % 1000 + l_quantity * 3)")
    return reports.merged_fragments(read(spark, d, ranges).withColumnRenamed("end_", "end"))


_COMMENTS = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '  ' ELSE 'x = 1; ' END AS before, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE ' y();' END AS after FROM orders"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'line' WHEN o_orderkey % 2 = 1 THEN 'preceding blanks' ELSE 'following blanks' END AS layout FROM orders")
def comment_strip_layout(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, _COMMENTS).select("o_orderkey", policy.comment_strip(F.col("before"), F.col("after")).alias("layout"))


@query(r"""WITH o AS (SELECT doc_id, line, unnest(regexp_extract_all(l, '[\p{L}\p{N}_]+')) AS word FROM (SELECT doc_id, unnest(string_split(replace(text, 'e', 'a'), chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)),
u AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word FROM documents)
SELECT doc_id, word, CAST(min(line) - 1 AS INT) AS line FROM o SEMI JOIN u USING (doc_id, word) GROUP BY ALL""")
def leak_survivors(spark: SparkSession, d: str) -> DataFrame:
    return reports.survivors(read(spark, d, "SELECT doc_id, text, replace(text, 'e', 'a') AS output FROM documents"))


_FORMATS = "(VALUES " + ", ".join(str(x) for x in formats.FORMATS) + ") f(name, engine, state, reach)"


@query(f"WITH c AS (SELECT CASE doc_id % 9 WHEN 0 THEN 'json' WHEN 1 THEN 'yaml' WHEN 2 THEN 'xml' WHEN 3 THEN 'text' WHEN 4 THEN 'text' WHEN 5 THEN 'mysql-tree' WHEN 6 THEN 'sqlserver-showplan-xml' WHEN 7 THEN 'oracle-grid-text' END AS format FROM ({duck(PLANS)})) SELECT engine, name, state, (SELECT count(*) FROM c WHERE format = name) AS captures FROM {_FORMATS}")
def coverage_denominator(spark: SparkSession, d: str) -> DataFrame:
    return reports.coverage(formats.catalogue(spark), formats.readings(read(spark, d, PLANS)))


@query(f"SELECT engine, count(*) AS formats, count(*) FILTER (state = 'admitted') AS admitted, count(*) FILTER (state = 'admitted' AND reach = 'default') AS by_default FROM {_FORMATS} GROUP BY engine")
def default_form_share(spark: SparkSession, d: str) -> DataFrame:
    return reports.default_form_share(formats.catalogue(spark))


@query(r"SELECT folded, list_sort(ways) AS ways FROM (SELECT lower(w) AS folded, list(DISTINCT w) AS ways FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_]+')) AS w FROM documents) GROUP BY 1) WHERE len(ways) > 1")
def two_way_spellings(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "SELECT text FROM documents").select(F.explode(X.split_words(F.col("text"), "[^A-Za-z_]+")).alias("spelling"))
    return reports.two_way_spellings(words)


@query(f"""SELECT doc_id, concat('Placeholder,Original,Kind', chr(13), chr(10), string_agg(concat(placeholder, ',', CASE WHEN contains(original, ',') THEN concat('"', replace(original, '"', '""'), '"') ELSE original END, ',', kind, chr(13), chr(10)), '' ORDER BY ordinal)) AS csv FROM ({duck(NAMES)}) WHERE placeholder IS NOT NULL GROUP BY doc_id""")
def csv_records(spark: SparkSession, d: str) -> DataFrame:
    return reports.mapping_csv(read(spark, d, NAMES))


@query(f"SELECT id, type, CASE WHEN id % 4 = 0 THEN type WHEN id % 4 = 1 THEN concat('a.T', id % 50) END AS resolved, CASE WHEN id % 4 = 1 THEN 'Gone$1' WHEN id % 4 > 1 THEN type END AS remainder FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('a.T', p_partkey % 50) WHEN 1 THEN concat('a.T', p_partkey % 50, '$Gone$1') ELSE concat('b.X', p_partkey) END AS type FROM part)")
def frame_resolution(spark: SparkSession, d: str) -> DataFrame:
    frames = read(spark, d, "SELECT p_partkey AS id, 'p' AS project_id, CASE p_partkey % 4 WHEN 0 THEN concat('a.T', p_partkey % 50) WHEN 1 THEN concat('a.T', p_partkey % 50, '$Gone$1') ELSE concat('b.X', p_partkey) END AS type FROM part")
    symbols = read(spark, d, "SELECT DISTINCT 'p' AS project_id, concat('a.T', p_partkey % 50) AS binary_name FROM part")
    return traces.resolve_types(frames, symbols).select("id", "type", "resolved", "remainder")


from . import plan_queries, source_queries  # noqa: E402, F401  (they register as well)
