"""Numbering names and writing them into the text.

Numbers come from one counter for all namespaces, in document order; a number whose word survives in the text is burnt.
Where no surviving word looks like a namespace in use followed by digits, no number can burn and one dense rank gives
the same result as the fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import splice


def first_occurrences(occurrences: DataFrame, by: str = "doc_id", key: str = "key") -> DataFrame:
    """One row a document and key, with the start of its first occurrence and that occurrence's namespace."""
    return occurrences.groupBy(by, key).agg(F.min(F.struct("start", "namespace", "original")).alias("f")).select(by, key, "f.*")


def number_fast(occurrences: DataFrame, next_number: int = 1, by: str = "doc_id", key: str = "key") -> DataFrame:
    """Placeholders by dense rank of first occurrence; a window a document."""
    rank = F.dense_rank().over(Window.partitionBy(by).orderBy("start", key))
    return first_occurrences(occurrences, by, key).withColumn("number", (F.lit(next_number - 1) + rank).cast("int")).withColumn("placeholder", F.concat("namespace", F.col("number").cast("string")))


def number_words(words: Column, namespace: str, next_number: int = 1) -> Column:
    """Of a row's words in order: (key, number, placeholder) of each different one, numbered as it first occurs.

    Distinct values keep the order of their first occurrence, so nothing is shuffled and nothing is ranked.
    """
    return F.transform(F.array_distinct(words), lambda w, i: F.struct(w.alias("key"), (i + next_number).alias("number"), F.concat(F.lit(namespace), (i + next_number).cast("string")).alias("placeholder")))


def can_burn(reserved: DataFrame, namespaces: list[str], by: str = "doc_id") -> DataFrame:
    """Documents with a surviving word that a placeholder could equal."""
    return reserved.where(F.col("word").rlike(rf"^(?:{'|'.join(namespaces)})\d+$")).select(by).distinct()


def fold(keys: list[tuple[str, str]], taken: set[str], number: int) -> Iterator[tuple[str, int, str]]:
    """(key, number, placeholder) for (key, namespace) in order; the counter passes over words that are taken."""
    for key, namespace in keys:
        while f"{namespace}{number}" in taken:
            number += 1
        yield key, number, f"{namespace}{number}"
        number += 1


def number_fold(occurrences: DataFrame, reserved: DataFrame, next_number: int = 1, by: str = "doc_id", key: str = "key") -> DataFrame:
    """Placeholders of the documents whose numbers can burn, by the fold; a group is one document's distinct keys."""
    firsts = first_occurrences(occurrences, by, key)
    taken = reserved.groupBy(by).agg(F.collect_set("word").alias("taken"))
    both = firsts.join(taken, by, "left")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start", key])
        words = group["taken"].iloc[0]
        done = list(fold(list(zip(group[key], group["namespace"], strict=True)), set(words) if words is not None else set(), next_number))
        return group.drop(columns="taken").assign(number=[n for _, n, _ in done], placeholder=[p for *_, p in done])

    return both.groupBy(by).applyInPandas(run, T.StructType([*firsts.schema, T.StructField("number", T.IntegerType()), T.StructField("placeholder", T.StringType())]))


def number(occurrences: DataFrame, reserved: DataFrame, namespaces: list[str], next_number: int = 1, by: str = "doc_id") -> DataFrame:
    """The fast path for all documents but those that can burn, the fold for these."""
    burning = can_burn(reserved, namespaces, by)
    fast = number_fast(occurrences.join(burning, by, "left_anti"), next_number, by)
    slow = number_fold(occurrences.join(burning, by, "left_semi"), reserved.join(burning, by, "left_semi"), next_number, by)
    return fast.unionByName(slow.select(fast.columns))


def rewritten(subjects: DataFrame, edits: DataFrame, by: str = "doc_id") -> DataFrame:
    """``subjects`` with the edits (start, end, text) of each document written into its text."""
    each = edits.groupBy(by).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text")).alias("edits"))
    joined = subjects.join(each, by, "left")
    return joined.withColumn("text", F.when(F.col("edits").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("edits")))).drop("edits")
