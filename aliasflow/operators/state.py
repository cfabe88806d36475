"""Durable and bounded state: the ledger of placeholders and the window of recent invocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The window of the history.
RUNS, DAYS = 50, 30


def commit(ledger: DataFrame, delta: DataFrame) -> DataFrame:
    """Append-only union by (project_id, key): a key that is there keeps its row."""
    both = ledger.select("project_id", "key", "placeholder", "original", F.lit(0).alias("age")).unionByName(delta.select("project_id", "key", "placeholder", "original", F.lit(1).alias("age")))
    return both.groupBy("project_id", "key").agg(F.min_by(F.struct("placeholder", "original"), F.struct("age", "placeholder")).alias("row")).select("project_id", "key", "row.*")


def commit_heads(heads: DataFrame, delta_heads: DataFrame) -> DataFrame:
    """The delta's counter replaces the old one; stems unite."""
    both = heads.select("project_id", "next_number", "stems", F.lit(0).alias("age")).unionByName(delta_heads.select("project_id", "next_number", "stems", F.lit(1).alias("age")))
    return both.groupBy("project_id").agg(F.max_by("next_number", "age").alias("next_number"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("stems")))).alias("stems"))


def clear(heads: DataFrame, project: Column) -> DataFrame:
    """Heads after a project's rows and stems are dropped: the counter stays."""
    return heads.withColumn("stems", F.when(project, F.array().cast("array<string>")).otherwise(F.col("stems")))


def clear_rows(ledger: DataFrame, projects: DataFrame) -> DataFrame:
    """The ledger without the rows of some projects, whose heads :func:`clear` keeps."""
    return ledger.join(projects.select("project_id").distinct(), "project_id", "left_anti")


def reset(ledger: DataFrame, invocations: DataFrame, heads: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger, history and heads after a reset of some projects: rows, stems and history go, counters and prefixes stay."""
    chosen = projects.select("project_id").distinct().withColumn("__reset", F.lit(True))
    kept = clear(heads.join(chosen, "project_id", "left"), F.coalesce("__reset", F.lit(False))).drop("__reset")
    return clear_rows(ledger, projects), clear_rows(invocations, projects), kept


def settings(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """(project_id, detect_roots, internal, third_party) with each change in place of what was stored; blanks and repeats of
    prefixes go.  Without either, roots are detected and there are no prefixes."""
    both = stored.withColumn("age", F.lit(0)).unionByName(changes.withColumn("age", F.lit(1)))
    last = both.groupBy("project_id").agg(F.max_by(F.struct("detect_roots", "internal", "third_party"), "age").alias("s")).select("project_id", "s.*")
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p != "")))
    return last.select("project_id", F.coalesce("detect_roots", F.lit(True)).alias("detect_roots"), clean(F.col("internal")).alias("internal"), clean(F.col("third_party")).alias("third_party"))


def is_stale(heads: DataFrame, seen: DataFrame) -> DataFrame:
    """Projects whose counter moved since it was seen."""
    return seen.alias("s").join(heads.alias("h"), "project_id", "left").select("project_id", (~F.col("h.next_number").eqNullSafe(F.col("s.next_number"))).alias("stale"))


def rerun(heads: DataFrame, seen: DataFrame, invocations: DataFrame) -> DataFrame:
    """Invocations to be named again before they are delivered: those of projects whose counter moved."""
    return invocations.join(is_stale(heads, seen).where("stale").select("project_id"), "project_id", "left_semi")


def bounded(invocations: DataFrame, now: Column, runs: int = RUNS, days: int = DAYS, by: str = "project_id") -> DataFrame:
    """What is at most ``days`` old, and of that the newest ``runs`` a project.

    ``now`` may be a column, such as each project's own clock.  The rank limit is applied before the shuffle too.
    """
    young = invocations.where(F.col("at") >= now - F.make_interval(days=F.lit(days)))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("at"), F.desc("seq")))
    return young.withColumn("rank", rank).where(F.col("rank") <= runs).drop("rank")
