"""Who owns a name, and what happens to it: policy as columns and as joins of short dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ROLE_PREFIXES, UNKNOWN

#: Methods whose names the language or its libraries fix.
FIXED_METHODS = ("main", "readObject", "writeObject", "readResolve", "writeReplace")


def shared_key(key: Column, roots: Column) -> Column:
    """The least key among the override roots, or the symbol's own."""
    return F.coalesce(F.array_min(F.transform(roots, lambda r: r["key"])), key)


def shared_key_qualified(qualified: Column, roots: Column) -> Column:
    """Whether the root that shared_key names is qualified."""
    return F.coalesce(F.array_min(F.transform(roots, lambda r: F.struct(r["key"], r["qualified"])))["qualified"], qualified)


def claimed_packages(packages: DataFrame, internal: DataFrame, third_party: DataFrame, package: str = "package") -> DataFrame:
    """``packages`` with claimed: the longest internal prefix is strictly longer than the longest third-party one.

    Prefixes hold whole segments.  Instead of comparing every package with every prefix, each package offers its few
    leading segments as keys of an equi-join, so neither list has to be small.
    """
    found = prefix_lengths(packages.select(F.col(package).alias("package")), internal, third_party).select(F.col("package").alias("__p"), (F.col("own") > F.col("other")).alias("claimed"))
    out = packages.join(found, packages[package] == found["__p"], "left").drop("__p")
    return out.withColumn("claimed", F.coalesce("claimed", F.lit(False)))


def prefix_lengths(packages: DataFrame, internal: DataFrame, third_party: DataFrame) -> DataFrame:
    """(package, own, other): the lengths of the longest prefixes of each kind that a package has, -1 without one."""
    both = internal.select(F.trim("prefix").alias("prefix"), F.lit(True).alias("own")).union(third_party.select(F.trim("prefix").alias("prefix"), F.lit(False)))
    both = both.where("prefix != ''").groupBy("prefix").agg(F.max(F.col("own").cast("int")).alias("own"), F.max((~F.col("own")).cast("int")).alias("other"))
    distinct = packages.select("package").distinct().where("package is not null")
    segments = F.split("package", r"\.")
    each = distinct.select("package", F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, 1, n), "."))).alias("prefix"))
    length = lambda c: F.max(F.when(F.col(c) == 1, F.length("prefix")).otherwise(-1))
    return each.join(both, "prefix").groupBy("package").agg(length("own").alias("own"), length("other").alias("other"))


def owned(origin: Column, claimed: Column) -> Column:
    return F.when(origin == "IN_CONTENT", True).when(origin == "LIBRARY", F.coalesce(claimed, F.lit(False))).otherwise(False)


def is_anonymized(origin: Column, claimed: Column, role: Column, package: Column) -> Column:
    """A package of one segment never is; else what is owned or unresolved."""
    top = (role == "PACKAGE") & ~F.coalesce(package, F.lit("")).contains(".")
    return F.when(top, False).when(origin.isin("IN_CONTENT", "UNRESOLVED"), True).when(origin == "LIBRARY", F.coalesce(claimed, F.lit(False))).otherwise(False)


def is_constrained() -> Column:
    """Of a row with owned, role, declared_name and roots_owned: its name is fixed, or it overrides what is not owned."""
    fixed = (F.col("role") == "METHOD") & F.col("declared_name").isin(*FIXED_METHODS)
    return F.col("owned") & (fixed | ~F.coalesce("roots_owned", F.lit(True)))


def constrained_keys(evidence: DataFrame) -> DataFrame:
    """Distinct shared keys that may not be renamed: owned, and a fixed method or an override of what is not owned.

    ``evidence``: shared, owned, role, declared_name, roots_owned (false if any override root is not owned).  One
    constrained occurrence constrains its key everywhere.
    """
    return evidence.where(is_constrained()).select("shared").distinct()


def namespace(origin: Column, role: Column) -> Column:
    prefix = F.coalesce(*(F.when(role == k, F.lit(v)) for k, v in ROLE_PREFIXES.items()))
    return F.when(origin == "UNRESOLVED", F.lit(UNKNOWN)).otherwise(prefix)


def mapped_kind(kind: Column, origin: Column, role: Column) -> Column:
    """What a mapping calls a name: a literal, unknown whatever its role, or its role."""
    return F.when(kind == "literal", F.lit("LITERAL")).when(origin == "UNRESOLVED", F.lit("UNKNOWN")).otherwise(role)


def outcomes(evidence: DataFrame) -> DataFrame:
    """``evidence`` with outcome: replaced or preserved, by would_replace, constrained keys and the user's own ticks."""
    constrained = constrained_keys(evidence).withColumn("constrained", F.lit(True))
    joined = evidence.join(constrained, "shared", "left")
    would = F.col("would_replace") & F.col("constrained").isNull() & ~F.coalesce("ticked", F.lit(False))
    return joined.withColumn("outcome", F.when(would, "replaced").otherwise("preserved")).drop("constrained")


def literal_coverage(kind: Column, start: Column, end: Column, text: Column, refs: Column) -> Column:
    """preserve, splice or str: references to symbols must tile the content up to signs."""
    inner = F.array_sort(F.filter(refs, lambda r: r["resolved"]))
    zero = F.struct(start.cast("int").alias("at"), F.lit(True).alias("ok"))
    letters = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0))).rlike(r"[\p{L}\p{Nd}]")
    walk = F.aggregate(inner, zero, lambda acc, r: F.struct(r["end"].cast("int").alias("at"), (acc["ok"] & (r["start"] >= acc["at"]) & (r["end"] <= end) & ~letters(acc["at"], r["start"])).alias("ok")))
    return F.when((kind != "STRING") | (start >= end), "preserve").when((F.size(inner) > 0) & walk["ok"] & ~letters(walk["at"], end), "splice").otherwise("str")


def comment_strip(before: Column, after: Column) -> Column:
    """How a stripped comment's line closes up, by what stands before and after it on the line."""
    blank = lambda c: ~c.rlike(r"\S")
    return F.when(blank(before) & blank(after), "line").when(~blank(before), "preceding blanks").otherwise("following blanks")
