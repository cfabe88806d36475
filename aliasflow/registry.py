"""Where queries register, and what makes their inputs: SQL over the supplied tables that Spark and DuckDB both run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def duck(sql: str) -> str:
    return sql.replace("AS STRING)", "AS VARCHAR)").replace("explode(split(", "unnest(string_split(")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        ALL[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def made(template: str, table: str = "part", key: str = "p_partkey", number: str = "p_size", word: str = "split_part(p_name, ' ', 1)") -> str:
    """SQL of a text that holds a row's key, number and word in place of %K, %N and %W."""
    said = template.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("\\", "' || chr(92) || '")
    for mark, column in (("%K", f"CAST({key} AS STRING)"), ("%N", f"CAST({number} AS STRING)"), ("%W", f"lower({word})")):
        said = said.replace(mark, f"' || {column} || '")
    return f"SELECT {key} AS doc_id, '{said}' AS text FROM {table}"
