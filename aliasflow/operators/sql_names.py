"""Queries in string literals, of the plain kind: table, column and schema names by their place, or a reason to leave the
whole fragment a literal.

A fragment is claimed only if every token of it is: keywords, numbers, signs and built-in calls stay, names get a role by
what stands before them.  What a full parser would have to decide falls back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.expressions import Token, chain, tokens
from ..plans.vocabulary import FUNCTIONS, TYPES

VERBS = frozenset("SELECT INSERT UPDATE DELETE WITH".split())
#: Words after which a table is named, and words that end such a place.
BEFORE_TABLE = frozenset("FROM JOIN INTO UPDATE".split())
KEYWORDS = VERBS | BEFORE_TABLE | frozenset(
    """WHERE AND OR NOT IN IS NULL LIKE BETWEEN EXISTS AS ON USING LEFT RIGHT FULL INNER OUTER CROSS NATURAL GROUP BY ORDER
    HAVING LIMIT OFFSET ASC DESC DISTINCT ALL ANY SOME UNION INTERSECT EXCEPT CASE WHEN THEN ELSE END VALUES SET CAST TRUE
    FALSE NULLS FIRST LAST OVER PARTITION ROWS RANGE""".split()
)
NAME = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("role", pa.string()), ("key", pa.string())]))


class FellBack(Exception):
    def __init__(self, reason: str, token: str = "") -> None:
        self.reason, self.token = reason, token


def names_in(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, role, key) of the names of a query; raises FellBack."""
    all_ = tokens(text, 0, len(text))
    if all_ is None:
        raise FellBack("DOES_NOT_PARSE")
    upper = lambda t: t.text.upper() if t.kind == "word" else ""
    if not all_ or upper(all_[0]) not in VERBS:
        raise FellBack("NOT_SQL", all_[0].text if all_ else "")
    for at, t in enumerate(all_):
        named_bind = t.text == ":" and at + 1 < len(all_) and all_[at + 1].kind in ("word", "number")
        if t.kind == "mark" and (t.text in "?$@" or named_bind):
            raise FellBack("BIND_PARAMETER", t.text)
    if sum((t.text == "(") - (t.text == ")") for t in all_ if t.kind == "mark"):
        raise FellBack("DOES_NOT_PARSE")
    aliases, out = set(), []
    table, at = False, 0
    found: list[tuple[Token, str]] = []
    while at < len(all_):
        t, word = all_[at], upper(all_[at])
        if word in KEYWORDS:
            table = word in BEFORE_TABLE
        elif t.is_name:
            parts = chain(all_, at)
            at += 2 * len(parts) - 2
            after = all_[at + 1] if at + 1 < len(all_) else None
            if after is not None and after.text == "(" and not table:
                if len(parts) > 1 or t.text.lower() not in FUNCTIONS:
                    raise FellBack("UNPROJECTABLE_REFERENCE", t.text)
            elif table:
                if len(parts) > 3:
                    raise FellBack("UNPROJECTABLE_REFERENCE", t.text)
                found += zip(parts, ["SCHEMA"] * (len(parts) - 1) + ["TABLE"], strict=True)
                if after is not None and upper(after) == "AS" and at + 2 < len(all_):
                    at, after = at + 1, all_[at + 2]
                if after is not None and after.is_name and upper(after) not in KEYWORDS:
                    at += 1
                    aliases.add(after.text)
                    found.append((after, "ALIAS"))
                table = False
            elif t.kind == "word" and len(parts) == 1 and t.text.lower() in TYPES and found and all_[at - 1].text.upper() in ("AS", "::"):
                pass
            elif upper(all_[at - 1]) == "AS" and len(parts) == 1:
                found.append((t, "COLUMN"))
            elif len(parts) > 3:
                raise FellBack("UNPROJECTABLE_REFERENCE", t.text)
            else:
                found += zip(parts, (["SCHEMA", "TABLE", "COLUMN"])[-len(parts) :], strict=True)
        elif t.text == ",":
            table = table or _in_from(all_, at)
        elif t.kind == "mark" and t.text not in "()*+-/%<>=!|.;" and t.text != "::":
            raise FellBack("UNCLAIMED_TOKEN", t.text)
        at += 1
    for t, role in found:
        kind = "TABLE" if role == "ALIAS" else role
        key = f"sql-declared:TABLE:{len(text)}:{text}:{t.text}" if kind == "TABLE" and t.text in aliases else f"sql:{kind}:{t.text}"
        out.append((*t.name, kind, key))
    return sorted(out)


def _in_from(all_: list[Token], at: int) -> bool:
    """A comma continues a list of tables if the last clause word before it, at its own depth, is FROM."""
    depth = 0
    for t in reversed(all_[:at]):
        depth += (t.text == ")") - (t.text == "(") if t.kind == "mark" else 0
        if depth < 0:
            return False
        if depth == 0 and t.kind == "word" and t.text.upper() in KEYWORDS - {"AS", "LEFT", "RIGHT", "INNER", "OUTER"}:
            return t.text.upper() == "FROM"
    return False


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            try:
                rows.append((None, None, [dict(zip(("start", "end", "role", "key"), x, strict=True)) for x in names_in(text or "")]))
            except FellBack as e:
                rows.append((e.reason, e.token, []))
        reason, token, names = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reason, pa.string()), pa.array(token, pa.string()), pa.array(names, NAME)], ["row", "text", "reason", "token", "names"])


def read_queries(fragments: DataFrame, text: str = "text") -> DataFrame:
    """``fragments`` with reason (why a fragment falls back; null if it is claimed), token (at which), and its names."""
    rest = [F.col(f"`{c}`") for c in fragments.columns if c not in (text, "reason", "token", "names")]
    some = fragments.select(F.struct(*rest).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([*some.schema.fields, *T.StructType.fromDDL("reason string, token string, names array<struct<start: int, end: int, role: string, key: string>>")])
    return some.mapInArrow(_run, schema).select("row.*", F.col("text").alias(text), "reason", "token", "names")


def query_sweep(read: DataFrame) -> DataFrame:
    """Fragments by outcome: claimed or the reason they fell back, how many, and their share in percent."""
    each = read.groupBy(F.coalesce("reason", F.lit("CLAIMED")).alias("outcome")).agg(F.count("*").alias("fragments"))
    total = read.agg(F.count("*").alias("n"))
    return each.join(F.broadcast(total)).select("outcome", "fragments", F.format_string("%.1f%%", 100.0 * F.col("fragments") / F.col("n")).alias("share"))


def fallbacks(read: DataFrame) -> DataFrame:
    """Fallbacks by reason and the token they stopped at, most frequent first."""
    return read.where("reason is not null").groupBy("reason", "token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason", "token")


def claimed_roles(read: DataFrame) -> DataFrame:
    return read.select(F.explode("names").alias("n")).groupBy(F.col("n.role").alias("role")).agg(F.count("*").alias("names"))


def tables_written_two_ways(read: DataFrame, text: str = "text") -> DataFrame:
    """Tables that claimed fragments spell in several ways, once folded to lower case."""
    name = F.substring(F.col(text), F.col("n.start") + 1, F.col("n.end") - F.col("n.start"))
    tables = read.select(text, F.explode("names").alias("n")).where("n.role = 'TABLE' and n.key like 'sql:%'").select(name.alias("spelling"))
    return tables.groupBy(F.lower("spelling").alias("folded")).agg(F.array_sort(F.collect_set("spelling")).alias("ways")).where(F.size("ways") > 1)
