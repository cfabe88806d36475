"""The catalogue of plan formats and their recognisers, as boolean columns over the head of a text.

A text is of a format only if exactly one recogniser accepts it; so texts of no format, or of two, go no further than
this projection, and no parser runs on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, engine, state, reach.
FORMATS = [
    ("text", "PostgreSQL", "admitted", "default"),
    ("json", "PostgreSQL", "admitted", "one flag"),
    ("yaml", "PostgreSQL", "admitted", "one flag"),
    ("xml", "PostgreSQL", "admitted", "one flag"),
    ("mysql-json-v2", "MySQL", "admitted", "one flag"),
    ("mysql-json-v1", "MySQL", "admitted", "one flag"),
    ("mysql-tree", "MySQL", "refused", "one flag"),
    ("mysql-tabular", "MySQL", "refused", "default"),
    ("mariadb-json", "MariaDB", "refused", "one flag"),
    ("mariadb-tabular", "MariaDB", "refused", "default"),
    ("sqlserver-showplan-xml", "SQL Server", "admitted", "one flag"),
    ("sqlserver-showplan-text", "SQL Server", "admitted", "one flag"),
    ("sqlserver-showplan-all", "SQL Server", "refused", "one flag"),
    ("sqlserver-statistics-profile", "SQL Server", "refused", "one flag"),
    ("oracle-grid-text", "Oracle", "admitted", "default"),
    ("oracle-sql-monitor-xml", "Oracle", "admitted", "further"),
]
# What a refused format is called, and what to use in its place.
FORMS = {
    "mysql-tree": ("MYSQL_TREE", "MYSQL_FORMAT_JSON"),
    "mysql-tabular": ("MYSQL_TABULAR", "MYSQL_FORMAT_JSON"),
    "mariadb-json": ("MARIADB", None),
    "mariadb-tabular": ("MARIADB", None),
    "sqlserver-showplan-all": ("SQLSERVER_SHOWPLAN_ALL", "SQLSERVER_SHOWPLAN_XML"),
    "sqlserver-statistics-profile": ("SQLSERVER_STATISTICS_PROFILE", "SQLSERVER_STATISTICS_XML"),
}
# The labels that open a node of a PostgreSQL text plan.
NODE_LABELS = [
    "Aggregate", "Append", "Bitmap Heap Scan", "Bitmap Index Scan", "BitmapAnd", "BitmapOr",
    "CTE Scan", "Custom Scan", "Delete on", "Foreign Scan", "Function Scan", "Gather Merge",
    "Gather", "GroupAggregate", "Group", "Hash Join", "HashAggregate", "HashSetOp", "Hash",
    "Incremental Sort", "Index Only Scan", "Index Scan", "Insert on", "Limit", "LockRows",
    "Materialize", "Memoize", "Merge Append", "Merge Join", "Merge on", "MixedAggregate",
    "Named Tuplestore Scan", "Nested Loop", "ProjectSet", "Recursive Union", "Result", "Sample Scan",
    "Seq Scan", "SetOp", "Sort", "Subquery Scan", "Table Function Scan", "Tid Range Scan",
    "Tid Scan", "Unique", "Update on", "Values Scan", "WindowAgg", "WorkTable Scan",
]

# Third keys of a JSON document after query_block and select_id; header cells of tables.
MYSQL_KEYS = "cost_info table nested_loop ordering_operation grouping_operation duplicates_removal union_result message optimized_away_subqueries windowing".split()
MARIADB_KEYS = "cost r_loops r_total_time_ms read_sorted_file const_condition having_condition table nested_loop ordering_operation duplicates_removal union_result".split()
MYSQL_TABLES = ["id select_type table partitions type possible_keys key key_len ref rows filtered Extra", "Level Code Message"]
MARIADB_TABLES = [
    "id select_type table type possible_keys key key_len ref rows Extra",
    "id select_type table type possible_keys key key_len ref rows filtered Extra",
    "id select_type table type possible_keys key key_len ref rows r_rows filtered r_filtered Extra",
]
SHOWPLAN_ALL = "StmtText StmtId NodeId Parent PhysicalOp LogicalOp Argument DefinedValues EstimateRows EstimateIO EstimateCPU AvgRowSize TotalSubtreeCost OutputList Warnings Type Parallel EstimateExecutions"
GRID = ["Id", "Operation", "Name", "Rows", "Bytes", "TempSpc", "Cost (%CPU)", "Cost", "Time", "E-Rows", "A-Rows", "A-Time", "Starts", "Buffers", "Reads", "Writes", "OMem", "1Mem", "O/1/M", "Used-Mem", "Used-Tmp"]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "name string, engine string, state string, reach string")


def head_lines(text: Column, n: int) -> Column:
    """The first n lines that are not blank, without carriage returns."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.replace(x, F.lit("\r"), F.lit("")))
    return F.slice(F.filter(lines, lambda x: x.rlike(r"\S")), 1, n)


def opens_node(line: Column) -> Column:
    """A line's body begins with a node label that no letter continues."""
    labels = "|".join(sorted(NODE_LABELS, key=len, reverse=True))
    return line.rlike(rf"^(?:\s*(?:->\s*)?(?:Parallel )?)(?:{labels})(?!\p{{L}})")


def _client_row(lines: Column, i: int) -> Column:
    """Cells of the i-th head line that is no rule: those between bars, or the line as it is."""
    rows = F.filter(lines, lambda x: ~x.rlike(r"^[+-]+$"))
    row = F.coalesce(F.get(rows, F.lit(i)), F.lit(""))
    cells = F.transform(F.split(F.regexp_replace(row, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return F.when(row.rlike(r"^\|.*\|$"), cells).otherwise(F.array(row))


def _is_table(cells: Column, headers: list[str]) -> Column:
    return F.array_join(cells, " ").isin(headers) & (F.size(cells) > 1)


def recognisers(text: Column, lines: Column | None = None) -> dict[str, Column]:
    """For each format of the catalogue; ``lines`` are the first four head lines, if a column holds them."""
    lines = head_lines(text, 4) if lines is None else lines
    line = lambda i: F.coalesce(F.get(lines, F.lit(i)), F.lit(""))
    first, second = line(0), line(1)
    opening = F.regexp_extract(text, r"^\s*<([A-Za-z][A-Za-z0-9]*)[\s/>]", 1)
    key = lambda i: F.regexp_extract(line(i), r'^\s*"([^"]*)":', 1)
    document = F.trim(first) == "{"
    block = document & (key(1) == "query_block") & second.rlike(r"\{\s*$") & (key(2) == "select_id")
    one, two = _client_row(lines, 0), _client_row(lines, 1)
    only = lambda cells: F.when(F.size(cells) == 1, F.element_at(cells, 1)).otherwise("")
    node = r"^[ |]*\|--"
    grid = lambda x: x.rlike(r"^\s*\|.+\|\s*$") & F.forall(F.split(F.regexp_replace(x, r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c).isin(GRID))
    tabs = F.array_join(F.transform(F.split(first, "\t"), lambda c: F.trim(c)), " ")
    return {
        "text": opens_node(first) & first.contains("  (cost="),
        "json": text.rlike(r"^\s*\["),
        "yaml": first.rlike(r"^\s*- ") & first.contains(":"),
        "xml": opening == "explain",
        "mysql-json-v2": document & (key(1) == "query"),
        "mysql-json-v1": block & key(3).isin(MYSQL_KEYS),
        "mysql-tree": only(one).startswith("-> ") | ((only(one) == "EXPLAIN") & only(two).startswith("-> ")),
        "mysql-tabular": _is_table(one, MYSQL_TABLES),
        "mariadb-json": block & key(3).isin(MARIADB_KEYS),
        "mariadb-tabular": _is_table(one, MARIADB_TABLES),
        "sqlserver-showplan-xml": opening == "ShowPlanXML",
        "sqlserver-showplan-text": first.rlike(node) | ((F.trim(first) == "StmtText") & second.rlike(node)),
        "sqlserver-showplan-all": tabs == SHOWPLAN_ALL,
        "sqlserver-statistics-profile": tabs == "Rows Executes " + SHOWPLAN_ALL,
        "oracle-grid-text": F.trim(first).rlike(r"^Plan hash value: \d+$") | grid(first) | (F.trim(first).rlike(r"^-{3,}$") & grid(second)),
        "oracle-sql-monitor-xml": opening == "report",
    }


def recognised(text: Column, lines: Column | None = None) -> Column:
    """The one format that accepts the text; null if none or several do."""
    hits = F.filter(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in recognisers(text, lines).items())), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 1, F.element_at(hits, 1))


def readings(subjects: DataFrame, text: str = "text", lines: str | None = None) -> DataFrame:
    """``subjects`` with format, status, form and recourse; no column added holds text of the input.  ``lines`` names a
    column of the first four head lines, if there is one.

    A text of an admitted format is ``recognised``; whether it is read, only its reader can say.  Others are ``refused``,
    with the form that names why and what to use in its place, or ``unreadable``.
    """
    # in a column of their own, lines are cut once for all recognisers
    lined = subjects if lines else subjects.withColumn("__lines", head_lines(F.col(text), 4))
    named = lined.withColumn("format", recognised(F.col(text), F.col(lines or "__lines"))).drop("__lines")
    pick = lambda i: F.coalesce(*(F.when(F.col("format") == name, F.lit(form[i])) for name, form in FORMS.items()))
    status = F.when(F.col("format").isNull(), "unreadable").when(F.col("format").isin(list(FORMS)), "refused").otherwise("recognised")
    return named.withColumn("status", status).withColumn("form", pick(0)).withColumn("recourse", pick(1))
