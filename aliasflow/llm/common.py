"""What several operators share: reading tables, sizing partitions, and tables in the shared folder."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing doc_id wherever documents are ordered or joined: it comes last.
NO_ID = 2**63 - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def text_hash(column: str = "text") -> Column:
    """Tells apart the texts of rows that share a doc_id, or have none."""
    return F.xxhash64(F.col(column).cast("string"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; the engine's own ``lower`` is far faster, and the same where no other letter has a case to lose."""
    return F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def split_words(text: Column, between: str) -> Column:
    """The words that runs of ``between`` separate; a split reads a text once, where extracting all matches copies it for each."""
    return F.array_remove(F.split(text, between), "")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's own estimate of the size of what a plan reads, before columns are pruned; for file scans, of the files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def shares(df: DataFrame, mb: float = 16.0, row: float = 0.0) -> int:
    """Into how many parts to deal work on ``df``: at least the session's shuffle partitions, and one for each ``mb`` of input.

    Where blocks send a packed row to every part, as many blocks as parts make rows by the square of the input.  There,
    blocks and parts grow as well, with the square root of the input, so that a row stands for ``row`` bytes of it or more:
    rows then grow as the input does, and a hundred TB are some million parts of a hundred MB.
    """
    size, least = input_bytes(df), partitions(df.sparkSession)
    if size >= 1 << 60:  # of a frame made from memory nothing is known
        return least
    return max(least, int(size / max(mb * 1e6, math.sqrt(size * row))) + 1)


def spread(df: DataFrame, mb: float, of: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` to a task for each ``mb`` of the input ``of``, where the session's shuffle partitions are
    fewer: a shuffle that follows by the same columns is this one, and its largest task does not grow with the input."""
    n = shares(of, mb)
    return df.repartition(n, *columns) if n > partitions(df.sparkSession) else df


def scan_number(df: DataFrame) -> Column:
    """The number of the task that reads a row, where each reading of ``df`` deals rows out to tasks alike: not behind a shuffle."""
    return F.spark_partition_id() if "Exchange" not in df._jdf.queryExecution().executedPlan().toString() else F.lit(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and all runs in one process, as in tests, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if (had := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return had.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="aliasflow-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write to the shared folder, which outlives executors, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
