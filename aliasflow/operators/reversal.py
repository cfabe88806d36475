"""Restoring originals in replies: exact words, one pass, first the recent history and then the ledger.

Replies explode into their distinct words only, which join both tables on (project, word) and come back as one map a
reply; the text is rebuilt from its tiles by looking words up in that map, so no tile is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ACCESSORS, LITERAL, ROLE_PREFIXES, UNKNOWN, accessor, decapitalised, number_of, stem_of, tiles, words


def newest_runs(invocations: DataFrame) -> DataFrame:
    """(project_id, placeholder, original) as the newest invocation that knows the placeholder has it."""
    return invocations.groupBy("project_id", "placeholder").agg(F.max_by("original", "seq").alias("original"))


def known(invocations: DataFrame, ledger: DataFrame) -> DataFrame:
    """History first, ledger second; blank originals of the ledger are no originals."""
    recent = newest_runs(invocations).withColumn("rank", F.lit(0))
    durable = ledger.where(F.trim("original") != "").groupBy("project_id", "placeholder").agg(F.min("original").alias("original")).withColumn("rank", F.lit(1))
    return recent.unionByName(durable).groupBy("project_id", "placeholder").agg(F.min_by("original", "rank").alias("original"))


def is_minted(token: Column, stems: Column) -> Column:
    """A default namespace with a number, or a recorded stem with one."""
    names = [*ROLE_PREFIXES.values(), UNKNOWN, LITERAL, *(a + "Field" for a in ACCESSORS)]
    return token.rlike(rf"^(?:{'|'.join(names)})\d+$") | ((number_of(token) != "") & F.coalesce(F.array_contains(stems, stem_of(token)), F.lit(False)))


def reason(token: Column, unsent: Column, stems: Column, next_number: Column) -> Column:
    """Why a word that looks like a placeholder was not restored; null if it does not look like one."""
    number = F.when(F.length(number_of(token)).between(1, 18), number_of(token).cast("long"))
    evicted = F.coalesce(number < next_number, F.lit(False))
    return F.when(unsent, "UNSENT_SPELLING").when(is_minted(token, stems), F.when(evicted, "EVICTED").otherwise("FOREIGN"))


def deanonymize(replies: DataFrame, invocations: DataFrame, ledger: DataFrame, heads: DataFrame) -> DataFrame:
    """``replies`` (project_id, doc_id, text) with text restored, restored (placeholders in order of first use) and unrestored.

    ``heads``: project_id, next_number, stems.
    """
    table = known(invocations, ledger).withColumnRenamed("placeholder", "asks")
    # each word asks for itself, and, if it reads as an accessor, for the word that it would derive from: one join for all
    own = F.posexplode(F.array_distinct(words(F.coalesce("text", F.lit("")))))
    tokens = replies.select("project_id", "doc_id", own.alias("at", "word"))

    def stripped(prefix: str) -> Column:
        cut = F.substring("word", F.lit(len(prefix) + 1), F.length("word"))
        spelt = F.col("word").startswith(prefix) & (F.length("word") > len(prefix)) & (accessor(F.lit(prefix), decapitalised(cut)) == F.col("word"))
        return F.when(spelt, decapitalised(cut))

    asks = F.filter(F.array("word", *map(stripped, ACCESSORS)), lambda x: x.isNotNull())
    found = tokens.select("project_id", "doc_id", "at", "word", F.explode(asks).alias("asks")).join(table, ["project_id", "asks"], "left")
    found = found.groupBy("project_id", "doc_id", "at", "word").agg(F.max(F.when(F.col("asks") == F.col("word"), F.col("original"))).alias("original"), F.max((F.col("asks") != F.col("word")) & F.col("original").isNotNull()).alias("other"))
    told = found.join(heads, "project_id", "left")
    unsent = F.col("original").isNull() & F.col("other")
    told = told.withColumn("reason", F.when(F.col("original").isNull(), reason(F.col("word"), unsent, F.col("stems"), F.coalesce("next_number", F.lit(1)))))
    seen = told.where("original is not null or reason is not null")
    packed = seen.groupBy("project_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "word", "original", "reason"))).alias("found"))
    joined = replies.join(packed, ["project_id", "doc_id"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<at:int,word:string,original:string,reason:string>>")))
    back = F.map_from_entries(F.transform(F.filter("found", lambda x: x["original"].isNotNull()), lambda x: F.struct(x["word"], x["original"])))
    joined = joined.withColumn("__back", back)
    text = F.array_join(F.transform(tiles(F.col("text")), lambda t: F.coalesce(F.element_at("__back", t), t)), "")
    return (
        joined.withColumn("restored", F.transform(F.filter("found", lambda x: x["original"].isNotNull()), lambda x: x["word"]))
        .withColumn("unrestored", F.transform(F.filter("found", lambda x: x["original"].isNull()), lambda x: F.struct(x["word"].alias("placeholder"), x["reason"].alias("reason"))))
        .withColumn("text", text)
        .drop("found", "__back")
    )


def paste_verdict(reversal: DataFrame) -> DataFrame:
    """none found, refused (something was not restored) or pasted."""
    status = F.when((F.size("restored") == 0) & (F.size("unrestored") == 0), "none").when(F.size("unrestored") > 0, "refused").otherwise("pasted")
    return reversal.withColumn("verdict", status)

