"""Column expressions over text: tiles, spans with offsets, splicing, spellings.

Offsets are code points and half-open.  Tiles are maximal runs of letters, numbers and underscores, or of anything else:
together they rebuild the text.  Names are the words that a placeholder could collide with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prefixes of placeholders by role, and of what has no role.
ROLE_PREFIXES = {
    "TYPE": "Type",
    "TYPE_PARAMETER": "T",
    "METHOD": "method",
    "FIELD": "field",
    "PARAMETER": "param",
    "PACKAGE": "pkg",
    "ANNOTATION": "Anno",
    "ATTRIBUTE": "attr",
    "LOCAL": "local",
    "LABEL": "label",
    "TABLE": "table",
    "COLUMN": "col",
    "SCHEMA": "schema",
    "INDEX": "idx",
}
UNKNOWN, LITERAL = "Unknown", "str"
ACCESSORS = ("get", "is", "set")


def split_words(text: Column, between: str) -> Column:
    """What runs of ``between`` separate; a split reads a text once, where extracting all matches copies it for each."""
    return F.array_remove(F.split(text, between, -1), "")


def tiles(text: Column) -> Column:
    return split_words(text, r"(?<=[\p{L}\p{N}_])(?=[^\p{L}\p{N}_])|(?<=[^\p{L}\p{N}_])(?=[\p{L}\p{N}_])")


def words(text: Column) -> Column:
    return split_words(text, r"[^\p{L}\p{N}_]+")


def names(text: Column) -> Column:
    """Words from their first letter on: numbers that a word begins with are no part of it."""
    return split_words(text, r"(?:[^\p{L}\p{N}_]|(?<![\p{L}\p{N}_])\p{N}+)+")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(numbers: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """What ``join`` makes of all numbers before each one; ``zero`` changes no number that it is joined with.

    A fold copies what it gathers at every step, so numbers are folded in runs of the square root of their count, and so
    are the runs' totals.
    """
    start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
    fold = lambda x: F.aggregate(x, start, lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def whole(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda i: fold(F.slice(x, i * size + 1, size)))
        return bound(runs, lambda r: F.flatten(F.zip_with(r, fold(F.transform(r, lambda y: y["at"]))["out"], lambda y, t: F.transform(y["out"], lambda v: join(t, v)))))

    return F.when(F.size(numbers) > 0, bound(numbers, whole)).otherwise(F.array().cast("array<int>"))


def spans_of(pieces: Column) -> Column:
    """Pieces of a text, one after another, with their offsets."""
    starts = lambda p: running(F.transform(p, F.length), lambda x, y: x + y, 0)
    return bound(pieces, lambda p: F.zip_with(p, starts(p), lambda x, at: F.struct(at.alias("start"), (at + F.length(x)).alias("end"), x.alias("match"))))


def reserved_words(text: Column, removed: Column | None = None) -> Column:
    """Distinct names in the text whose first character no removed span (start, end) holds, sorted."""
    if removed is None:
        return F.array_sort(F.array_distinct(names(text)))
    # a name begins where the numbers at the begin of a tile end
    first = lambda s: s["start"] + F.length(F.regexp_extract(s["match"], r"^\p{N}*", 0))
    spans = F.filter(spans_of(tiles(text)), lambda s: s["match"].rlike(r"^\p{N}*[\p{L}_]") & ~F.exists(removed, lambda r: (r["start"] <= first(s)) & (first(s) < r["end"])))
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.regexp_replace(s["match"], r"^\p{N}+", ""))))


def splice(text: Column, edits: Column) -> Column:
    """The text with each edit (start, end, text) in place of its span; edits may come in any order but must not overlap."""

    def written(e: Column) -> Column:
        """What stands between each edit and the one before it, the edit's text, and the rest."""
        before = F.concat(F.array(F.lit(0)), F.transform(e, lambda x: x["end"].cast("int")))
        kept = F.zip_with(before, e, lambda at, x: F.concat(F.when(x.isNull(), F.substring(text, at + 1, F.length(text))).otherwise(F.substring(text, at + 1, x["start"] - at)), F.coalesce(x["text"], F.lit(""))))
        return F.array_join(kept, "")

    return bound(F.array_sort(edits), written)


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def decapitalised(word: Column) -> Column:
    return F.concat(F.lower(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def accessor(prefix: Column, field: Column) -> Column:
    """The spelling of an accessor of a field."""
    return F.concat(prefix, capitalised(field))


def stem_of(placeholder: Column) -> Column:
    return F.regexp_replace(placeholder, r"\p{Nd}+$", "")


def number_of(placeholder: Column) -> Column:
    """The trailing digits, '' without any."""
    return F.regexp_extract(placeholder, r"\p{Nd}*$", 0)


def reserved_namespaces() -> list[str]:
    own = [*ROLE_PREFIXES.values(), UNKNOWN, LITERAL]
    return own + [a + p[0].upper() + p[1:] for a in ACCESSORS for p in ROLE_PREFIXES.values()]


def stem_rejection(stem: Column) -> Column:
    """Why a chosen stem can't be used; null if it can, or is blank."""
    t = F.regexp_replace(stem, r"^\s+|\s+$", "")
    part = r"\p{L}\p{Nl}\p{Sc}\p{Pc}\p{Nd}\p{Mn}\p{Mc}\p{Cf}\x00-\x08\x0E-\x1B\x7F-\x9F"
    return (
        F.when(t == "", F.lit(None))
        .when(~t.rlike(rf"^[\p{{L}}\p{{Nl}}\p{{Sc}}\p{{Pc}}][{part}]*$"), "NOT_AN_IDENTIFIER")
        .when(t.contains("$"), "CARRIES_A_DOLLAR")
        .when(t.rlike(r"\p{Nd}$"), "ENDS_WITH_A_DIGIT")
        .when(t.isin(reserved_namespaces()), "RESERVED_NAMESPACE")
    )


def root_package(package: Column) -> Column:
    """The first two segments."""
    return F.substring_index(package, ".", 2)


def csv_field(value: Column) -> Column:
    return F.when(value.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_record(*values: Column) -> Column:
    return F.concat(F.concat_ws(",", *(csv_field(v) for v in values)), F.lit("\r\n"))
