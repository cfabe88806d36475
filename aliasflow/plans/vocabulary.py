"""Words that PostgreSQL's plan printer writes itself, and what may stand in the rows of a text plan."""

from __future__ import annotations

# Keywords, built-in types and functions, constants, phrases.
WORDS = frozenset(
    """AND OR NOT IS ISNULL NOTNULL NULL IN EXISTS LIKE ILIKE SIMILAR TO BETWEEN SYMMETRIC ASYMMETRIC CASE WHEN THEN
    ELSE END ANY ALL SOME AS ASC DESC NULLS FIRST LAST DISTINCT ON USING COLLATE ARRAY ROW CAST INTERVAL AT TIME ZONE
    LOCAL FOR FROM WITH WITHOUT ORDER BY GROUP PARTITION OVER RANGE ROWS GROUPS UNBOUNDED PRECEDING FOLLOWING CURRENT
    EXCLUDE TIES OTHERS FILTER WHERE ESCAPE OPERATOR GROUPING SETS ROLLUP CUBE WITHIN VARIADIC ORDINALITY LATERAL TRUE
    FALSE UNKNOWN DEFAULT VALUES KEY SubPlan InitPlan NaN Infinity true false""".split()
)
TYPES = frozenset(
    """bool boolean bytea char bpchar varchar text name int int2 int4 int8 smallint integer bigint numeric decimal real
    float float4 float8 money date timestamp timestamptz timetz time interval uuid json jsonb jsonpath xml inet cidr
    macaddr macaddr8 oid regclass regtype regproc record void bit varbit tsvector tsquery point lseg line box path
    polygon circle int4range int8range numrange tsrange tstzrange daterange anyarray""".split()
)
FUNCTIONS = frozenset(
    """abs age array_agg array_append array_cat array_length array_position array_remove array_to_string avg btrim
    cardinality ceil ceiling char_length character_length coalesce concat concat_ws corr count cume_dist current_date
    current_schema current_time current_timestamp current_user date_part date_trunc decode degrees dense_rank div encode
    every exp extract first_value floor format generate_series greatest initcap json_agg json_build_object jsonb_agg
    jsonb_build_object jsonb_object_agg lag last_value lead least left length ln localtime localtimestamp log lower lpad
    ltrim make_date make_timestamp max md5 min mod mode now nth_value ntile nullif num_nonnulls octet_length overlay
    percent_rank percentile_cont percentile_disc pi position power radians random rank regexp_matches regexp_replace
    regexp_split_to_array regexp_split_to_table repeat replace reverse right round row_number rpad rtrim session_user
    sign split_part sqrt starts_with stddev stddev_pop stddev_samp string_agg string_to_array strpos substr substring
    sum timeofday to_char to_date to_hex to_json to_jsonb to_number to_timestamp translate trim trunc unnest upper
    var_pop var_samp variance version width_bucket nextval currval setval pg_typeof""".split()
)
CONSTANTS = frozenset("NULL true false TRUE FALSE".split())
PHRASES = (
    "hashed SubPlan",
    "double precision",
    "character varying",
    "bit varying",
    "timestamp with time zone",
    "timestamp without time zone",
    "time with time zone",
    "time without time zone",
)
# Rows of a text plan, by what becomes of what follows the colon.
ROWS = {
    "declared": "Subplan Name",
    "expression": "Output|Filter|Index Cond|Recheck Cond|TID Cond|Join Filter|Hash Cond|Merge Cond|One-Time Filter|Conflict Filter|Sort Key|Presorted Key|Group Key|Hash Key|Cache Key|Function Call|Order By|Sampling",
    "boolean": "Single Copy",
    "enum": "Conflict Resolution|Cache Mode",
    "masked": "Query Text|Remote SQL|Query Identifier",
    "parameters": "Query Parameters",
    "measured": "Planning Time|Execution Time|Planning|Execution|Total Runtime|Buffers|I/O Timings|WAL|Sort Method|Sort Space Used|Sort Space Type|Sort Methods Used|Sort Space Memory|Average Sort Space Used|Peak Sort Space Used|Group Count|Workers Planned|Workers Launched|Worker|Heap Blocks|Exact Heap Blocks|Lossy Heap Blocks|Buckets|Batches|Memory Usage|Peak Memory Usage|Disk Usage|Rows Removed by Filter|Rows Removed by Index Recheck|Rows Removed by Join Filter|Rows Removed by Conflict Filter|Functions|Options|Timing|JIT|Full-sort Groups|Pre-sorted Groups|Hits|Misses|Evictions|Overflows|Storage|Maximum Storage|Tuples Inserted|Conflicting Tuples|Heap Fetches|Index Searches|Subplans Removed|Disabled Nodes|Time|Calls|Tuples Updated|Tuples Deleted|Tuples Skipped",
}
RAW_NAME_ROWS = ("Settings:", "Conflict Arbiter Indexes:", "Trigger ")
BY_LABEL = {label: kind for kind, labels in ROWS.items() for label in labels.split("|")}

# Oracle's words.
ORACLE_WORDS = frozenset(
    """filter access storage AND OR NOT IS NULL IN EXISTS LIKE BETWEEN CASE WHEN THEN ELSE END ANY ALL SOME AS ASC DESC
    NULLS FIRST LAST DISTINCT ON USING ROWNUM ROWID LEVEL PRIOR CONNECT_BY_ROOT CONNECT_BY_ISLEAF CONNECT_BY_ISCYCLE
    SYSDATE SYSTIMESTAMP USER TRUE FALSE INTERVAL DATE TIMESTAMP TO FROM FOR OF ESCAPE PARTITION SUBPARTITION ORDER BY
    GROUP OVER PRECEDING FOLLOWING UNBOUNDED CURRENT ROW ROWS RANGE WITHIN""".split()
)
ORACLE_BUILTINS = frozenset(
    """NUMBER VARCHAR2 NVARCHAR2 CHAR NCHAR CLOB NCLOB BLOB BFILE RAW LONG FLOAT BINARY_FLOAT BINARY_DOUBLE ROWID UROWID
    XMLTYPE ABS ADD_MONTHS AVG CAST CEIL CHR COALESCE CONCAT COUNT CURRENT_DATE CURRENT_TIMESTAMP DECODE DENSE_RANK
    EXTRACT FLOOR GREATEST INITCAP INSTR LAG LAST_VALUE LEAD LEAST LENGTH LENGTHB LOWER LPAD LTRIM MAX MIN MOD
    MONTHS_BETWEEN NULLIF NVL NVL2 NUMTODSINTERVAL NUMTOYMINTERVAL POWER RANK REGEXP_LIKE REGEXP_REPLACE REGEXP_SUBSTR
    REPLACE ROUND ROW_NUMBER RPAD RTRIM SIGN SQRT SUBSTR SUBSTRB SUM SYS_EXTRACT_UTC SYS_GUID SYS_OP_C2C SYS_OP_DESCEND
    TO_CHAR TO_DATE TO_NUMBER TO_TIMESTAMP TRIM TRUNC UPPER""".split()
)
ORACLE_PHRASES = (
    "IS NOT NULL",
    "IS NULL",
    "NOT IN",
    "NOT EXISTS",
    "NOT LIKE",
    "NOT BETWEEN",
    "TIMESTAMP WITH TIME ZONE",
    "TIMESTAMP WITH LOCAL TIME ZONE",
    "INTERVAL DAY TO SECOND",
    "INTERVAL YEAR TO MONTH",
)
