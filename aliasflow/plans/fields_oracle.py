"""What becomes of each attribute and element of an Oracle SQL monitor report; scope:X descends into scope X.

("by", label, {value: a}, b) is a where the element's label has the value, else b.  #text is an element's character data.
"""

# Label and treatment, element by element.
ORACLE = {
    "report": {"db_version": "version", "report_id": "masked", "report_parameters": "scope:report_parameters", "sql_monitor_report": "scope:monitor"},
    "report_parameters": {"sql_id": "masked", "type": "token", "report_level": "token"},
    "monitor": {
        "version": "version",
        "status": "status",
        "sql_id": "masked",
        "sql_exec_id": "measured",
        "sql_exec_start": "measured",
        "user": "masked",
        "module": "masked",
        "service": "masked",
        "instance_id": "measured",
        "session_id": "measured",
        "sql_fulltext": "masked",
        "binds": "scope:binds",
        "stats": "scope:stats",
        "plan": "scope:operations",
    },
    "binds": {"bind": "scope:bind"},
    "bind": {
        "name": "masked",
        "pos": "measured",
        "dty": "count",
        "dtystr": "type_name",
        "maxlen": "dropped",
        "len": "dropped",
        "csid": "count",
        "#text": ("by", "dty", {"2": "bound_number", "100": "bound_number", "101": "bound_number"}, "bound_value"),
    },
    "stats": {"type": "token", "stat": "scope:stat"},
    "stat": {"name": "token", "#text": "measured"},
    "operations": {"operation": "scope:operation_row"},
    "operation_row": {
        "id": "measured",
        "name": "operation",
        "options": "operation",
        "depth": "measured",
        "cost": "measured",
        "cardinality": "measured",
        "bytes": "measured",
        "object": "scope:operation_object",
        "operation": "scope:operation_row",
    },
    "operation_object": {"name": ("by", "type", {"INDEX": "name:INDEX"}, "name:TABLE"), "owner": "name:SCHEMA", "alias": "declared", "type": "enum"},
}
# Words of type names, and what may stand in parentheses after one.
TYPE_WORDS = frozenset(
    """NUMBER FLOAT BINARY_FLOAT BINARY_DOUBLE INTEGER SMALLINT DECIMAL NUMERIC REAL DOUBLE PRECISION PLS_INTEGER
    BINARY_INTEGER BOOLEAN VARCHAR2 NVARCHAR2 VARCHAR CHAR NCHAR LONG RAW CLOB NCLOB BLOB BFILE JSON XMLTYPE VECTOR ROWID
    UROWID REF CURSOR DATE TIMESTAMP INTERVAL YEAR MONTH DAY SECOND TO WITH WITHOUT LOCAL TIME ZONE""".split()
)
TYPE_SIZE = r"(\d+|\*)(,\d+)?( (BYTE|CHAR))?"
# Hints of an outline, those whose argument is a version, and the words of their arguments.
HINTS = frozenset(
    """BEGIN_OUTLINE_DATA END_OUTLINE_DATA IGNORE_OPTIM_EMBEDDED_HINTS OPTIMIZER_FEATURES_ENABLE DB_VERSION ALL_ROWS
    FIRST_ROWS OPT_PARAM OPT_ESTIMATE ADAPTIVE_PLAN DYNAMIC_SAMPLING CURSOR_SHARING_EXACT OUTLINE OUTLINE_LEAF QB_NAME
    NO_QUERY_TRANSFORMATION FULL INDEX INDEX_ASC INDEX_DESC INDEX_RS_ASC INDEX_RS_DESC INDEX_FFS INDEX_SS INDEX_SS_ASC
    INDEX_SS_DESC INDEX_JOIN INDEX_COMBINE NO_INDEX NO_ACCESS BITMAP_TREE AND_EQUAL ROWID BATCH_TABLE_ACCESS_BY_ROWID
    NO_BATCH_TABLE_ACCESS_BY_ROWID LEADING ORDERED USE_NL USE_NL_WITH_INDEX NO_USE_NL USE_MERGE NO_USE_MERGE USE_HASH
    NO_USE_HASH NLJ_BATCHING NO_NLJ_BATCHING SWAP_JOIN_INPUTS NO_SWAP_JOIN_INPUTS SEMIJOIN SEMI_TO_INNER PARTIAL_JOIN
    NO_PARTIAL_JOIN USE_CONCAT NO_EXPAND ELIMINATE_JOIN NO_ELIMINATE_JOIN MERGE NO_MERGE UNNEST NO_UNNEST PUSH_PRED
    NO_PUSH_PRED PUSH_SUBQ NO_PUSH_SUBQ ORDER_SUBQ PLACE_GROUP_BY NO_PLACE_GROUP_BY GBY_PUSHDOWN NO_GBY_PUSHDOWN
    USE_HASH_AGGREGATION NO_USE_HASH_AGGREGATION STAR_TRANSFORMATION NO_STAR_TRANSFORMATION ELIMINATE_OBY
    NO_ELIMINATE_OBY NO_CONNECT_BY_FILTERING VECTOR_TRANSFORM NO_VECTOR_TRANSFORM PARALLEL NO_PARALLEL PQ_DISTRIBUTE
    PX_JOIN_FILTER NO_PX_JOIN_FILTER RESULT_CACHE NO_RESULT_CACHE""".split()
)
VERSION_HINTS = frozenset(["OPTIMIZER_FEATURES_ENABLE", "DB_VERSION"])
HINT_WORDS = frozenset(
    """TABLE INDEX_SCAN INDEX_FILTER INDEX_SKIP_SCAN JOIN GROUP_BY ROWS SCALE_ROWS MIN MAX QUERY_BLOCK HASH BROADCAST NONE
    PARTIAL RANDOM RANGE REPLICATE LOCAL SERIAL AUTO MANUAL DEFAULT""".split()
)
QUERY_BLOCK = r"[A-Z]{3}\$[0-9A-Z]+"
