"""Into how many parts rows are dealt before Python works on them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def parts(df: DataFrame, mb: int = 16) -> int:
    """One for each core or shuffle partition at least, and for each ``mb`` that Catalyst expects, if it expects anything."""
    session = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return max(least, size // (mb << 20) if size < 1 << 50 else 0)
