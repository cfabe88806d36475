"""A corpus pipeline: toxic documents and near-duplicates go, contaminated documents go, personal data is masked, and
sources are mixed to target weights.

Each stage takes all that its predecessor kept, is written as Parquet to the shared folder, and reread by the next.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aliasflow.llm.common import id_key, stored, table, text_hash
from aliasflow.llm.decontaminate import decontaminate
from aliasflow.llm.mixing import mix
from aliasflow.llm.near_dedup import near_duplicates
from aliasflow.llm.pii import redact
from aliasflow.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that more likely than not have a severity grade above 0 go."""
    return toxicity(docs, table(spark, sf_dir, "labels")).where("grade = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays, once; texts that share an id, or
    have none, are documents of their own."""
    kept = near_duplicates(docs).where("stays").select("key", "same").distinct()
    keyed = docs.withColumn("key", id_key()).withColumn("same", text_hash())
    return keyed.join(kept.hint("shuffle_hash"), ["key", "same"]).dropDuplicates(["key", "same"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat so that sources reach their target weights, in a global random order."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: The first two stages are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
