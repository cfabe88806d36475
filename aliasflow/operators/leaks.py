"""Leak oracles: what of an input's own names an output still says, over plans, sources and traces.

A universe is a table of spellings; an output is cut into the spellings it holds, line by line; survivors are a semi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.vocabulary import ORACLE_PHRASES, ORACLE_WORDS, PHRASES, WORDS

#: A run of letters, digits, underscores and dollars that no digit begins; and a number with what clings to it.
RUN = r"[\p{L}_][\p{L}\p{Nd}_$]*"
AMOUNT = r"\p{Nd}(?:[\p{L}\p{Nd}_$]|\.(?=\p{Nd}))*"
#: Delimited names with their marks doubled inside, and an open mark with the rest of the text.
CLOSED = '"(?:[^"]|"")*"|`(?:[^`]|``)*`|\\[(?:[^\\]]|\\]\\])*\\]'
OPEN = '["`\\[](?s:.*)'
SPELLING = "array<struct<spelling:string,delimited:boolean>>"
# What the printer of a trace writes itself.
TRACE_WORDS = "Exception in thread Caused by Suppressed at more Native Method Unknown Source init clinit _COROUTINE _BOUNDARY _CREATION _ CoroutineDebugging kt Coroutine boundary creation stacktrace".split()


def _runs(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(f"{AMOUNT}|{RUN}"), F.lit(0)), lambda x: ~x.rlike(r"^\p{Nd}"))


def plan_spellings(text: Column) -> Column:
    """Every spelling in a plan, whatever its engine, and whether it stands in delimiters; distinct, delimited ones first."""
    pieces = F.regexp_extract_all(text, F.lit(f"{CLOSED}|{OPEN}|{AMOUNT}|{RUN}"), F.lit(0))

    def of(piece: Column) -> Column:
        mark = F.substring(piece, 1, 1)
        close = F.translate(mark, "[", "]")
        closed = piece.rlike(rf"^(?:{CLOSED})$")
        inner = F.replace(F.substring(piece, F.lit(2), F.length(piece) - 2), F.concat(close, close), close)
        one = closed & inner.rlike(r'^[\p{L}_][\p{L}\p{Nd}_$."`\]]*$') & ~inner.rlike(r"^[\p{L}\p{Nd}_$]*$")
        said = lambda words, flag: F.transform(words, lambda w: F.struct(w.alias("spelling"), F.lit(flag).alias("delimited")))
        none = F.array().cast(SPELLING)
        quoted = F.concat(said(_runs(inner), True), F.when(one, said(F.array(inner), True)).otherwise(none))
        return F.when(closed, quoted).when(mark.isin('"', "`", "["), said(_runs(F.substring(piece, F.lit(2), F.length(piece))), False)).when(mark.rlike(r"\p{Nd}"), none).otherwise(said(F.array(piece), False))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(pieces, of)).cast(SPELLING)), lambda a, b: F.when(a["delimited"] == b["delimited"], F.when(a["spelling"] < b["spelling"], -1).when(a["spelling"] > b["spelling"], 1).otherwise(0)).when(a["delimited"], -1).otherwise(1))


def printer_words(engine: str) -> list[str]:
    """Words that an engine's printer writes by itself; built-in names are never among them."""
    words, phrases = {"PostgreSQL": (WORDS, PHRASES), "Oracle": (ORACLE_WORDS, ORACLE_PHRASES)}.get(engine, (frozenset(), ()))
    return sorted({*words, *(w for p in phrases for w in p.split())})


def plan_universe(plans: DataFrame, engine: str, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, spelling, delimited): a plan's spellings without the printer's words, unless these stand in delimiters."""
    each = plans.select(by, F.explode(plan_spellings(F.col(text))).alias("s")).groupBy(by, F.col("s.spelling").alias("spelling")).agg(F.max("s.delimited").alias("delimited"))
    return each.where(F.col("delimited") | ~F.col("spelling").isin(printer_words(engine)))


def plan_survivors(universe: DataFrame, outputs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """Spellings of the universe that the output holds, with the first line (from 1) that does."""
    lines = outputs.select(by, F.posexplode(F.split(text, "\n", -1)).alias("line", "l"))
    found = lines.select(by, (F.col("line") + 1).alias("line"), F.explode(plan_spellings(F.col("l"))).alias("s")).groupBy(by, F.col("s.spelling").alias("spelling")).agg(F.min("line").alias("line"))
    return universe.join(found, [by, "spelling"])


def source_spellings_in(line: Column, binary: bool = False) -> Column:
    """Identifiers of a line and every chain of two or more that dots join; of binary names also what lies between dollars."""
    name = r"[\p{L}_$][\p{L}\p{Nd}_$]*"
    words = F.regexp_extract_all(line, F.lit(name), F.lit(0))
    parts = F.flatten(F.transform(words, lambda w: F.array_remove(F.split(w, r"\$"), ""))) if binary else F.array().cast("array<string>")

    def chains(chain: Column) -> Column:
        own = F.split(chain, r"\s*\.\s*")
        froms = F.sequence(F.lit(1), F.size(own) - 1)
        return F.flatten(F.transform(froms, lambda a: F.transform(F.sequence(F.lit(2), F.size(own) - a + 1), lambda n: F.array_join(F.slice(own, a, n), "."))))

    qualified = F.flatten(F.transform(F.regexp_extract_all(line, F.lit(rf"{name}(?:\s*\.\s*{name})+"), F.lit(0)), chains))
    return F.array_distinct(F.concat(words, parts, qualified))


def source_survivors(universe: DataFrame, library: DataFrame, outputs: DataFrame, binary: bool = False, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, name, line): names of our own, which no library declares, that an output still says.

    ``universe`` and ``library``: name.  A universe that comes out empty would call everything clean: see :func:`sound`.
    """
    own = universe.select("name").distinct().join(library.select("name").distinct(), "name", "left_anti")
    lines = outputs.select(by, F.posexplode(F.split(text, "\n", -1)).alias("line", "l"))
    said = lines.select(by, (F.col("line") + 1).alias("line"), F.explode(source_spellings_in(F.col("l"), binary)).alias("name"))
    return said.join(own, "name", "left_semi").groupBy(by, "name").agg(F.min("line").alias("line"))


def trace_universe(traces: DataFrame, library: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, name): sub-tokens of traces, dollars apart, that begin with a letter or underscore, without declared and printer's words."""
    tokens = F.filter(F.array_distinct(F.split(text, r"[^\p{L}\p{Nd}_]+")), lambda w: w.rlike(r"^[\p{L}_]"))
    return traces.select(by, F.explode(tokens).alias("name")).where(~F.col("name").isin(TRACE_WORDS)).join(library.select("name").distinct(), "name", "left_anti").select(by, "name")


def trace_survivors(universe: DataFrame, outputs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    lines = outputs.select(by, F.posexplode(F.split(text, "\n", -1)).alias("line", "l"))
    said = lines.select(by, (F.col("line") + 1).alias("line"), F.explode(F.array_distinct(F.split("l", r"[^\p{L}\p{Nd}_]+"))).alias("name")).groupBy(by, "name").agg(F.min("line").alias("line"))
    return universe.join(said, [by, "name"])


def sound(universe: DataFrame, outputs: DataFrame, survivors: DataFrame, inputs_survive: DataFrame) -> DataFrame:
    """The oracle's proof of itself, as one row: its universe is not empty, and it finds every name in the input itself.

    ``inputs_survive``: the survivors when the inputs take the place of the outputs.
    """
    count = lambda df, name: df.agg(F.count("*").alias(name))
    row = count(universe, "universe").join(count(inputs_survive, "found_in_input")).join(count(survivors, "survivors")).join(count(outputs, "outputs"))
    return row.withColumn("can_fail", (F.col("universe") > 0) & (F.col("found_in_input") >= F.col("universe")))
