"""Reading subjects and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBJECTS = "doc_id long, project_id string, seq long, kind string, text string, root_package string, keep_comments boolean"
LEDGER = "project_id string, key string, placeholder string, original string"


def read_texts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Whole text files as subjects: one row a file, doc_id a hash of its path."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.lit(kind).alias("kind"), F.col("value").alias("text"))


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBJECTS).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path).select("project_id", "key", "placeholder", "original")


def write_ledger(ledger: DataFrame, path: str) -> None:
    """By a bucket of the project, so that one project's rows lie in one folder of bounded number."""
    ledger.withColumn("bucket", F.pmod(F.xxhash64("project_id"), F.lit(256))).repartition("bucket").write.partitionBy("bucket").parquet(path, mode="overwrite")


def write_csv_texts(exports: DataFrame, path: str, column: str = "csv") -> None:
    """Texts whose records end as they are, one after another."""
    exports.select(F.regexp_replace(column, r"\r\n\z", "").alias("value")).write.text(path, lineSep="\r\n")
