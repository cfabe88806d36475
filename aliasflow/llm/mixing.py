"""Mixing sources to target weights by Poisson replication, in built-in functions only.

Each source s with n of the N documents is to make up a share w of a mixture of ``size`` documents, so that its
documents repeat w * size / n times on average.  A document's number of copies is the Poisson quantile, at that mean, of
a uniform number drawn from a hash of its key and a seed: the same on every run and machine, without any coordination.
Documents are exploded by their copies and ordered globally by a hash of key and copy.

* Without given weights, a source's weight is its count to the power ``temperature``.
* A null source is a source of its own.  Given weights leave sources that they do not name out.
* Rows of equal key and text get equal numbers; a null key or text counts as ''.  No documents give no rows.
* Existing columns named like the added ones are replaced; others, whatever their names, are kept.
* Sources are counted with one row a source and task.  Of a source's distribution only the numbers of copies within
  twelve standard deviations are kept; the table of sources is broadcast only if it holds at most ``most_numbers`` of
  them, and is joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ADDED = ["copies", "copy", "mix_key"]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def least_copies(mean: Column) -> Column:
    """Fewer copies than this have no probability that double precision tells from 0; none are left out of small means."""
    low = F.floor(mean - 12 * F.sqrt(mean) - 25).cast("long")
    return F.when(low < 32, F.lit(0).cast("long")).otherwise(low)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = least, least + 1, ... as far as double precision tells it from 1."""
    low = least_copies(mean)
    n = low.cast("double")
    # log P(X = low); Stirling's series for log(low!) is exact to double precision from 32 on
    factorial = n * F.log(n) - n + 0.5 * F.log(2 * F.pi() * n) + 1 / (12 * n) - 1 / (360 * F.pow(n, F.lit(3.0))) + 1 / (1260 * F.pow(n, F.lit(5.0)))
    first = F.when(low > 0, -mean + n * F.log(mean) - factorial).otherwise(-mean)
    last = F.ceil(mean + 12 * F.sqrt(mean) + 25).cast("long")
    terms = F.transform(F.sequence(low + 1, last), lambda k: F.log(mean) - F.log(k.cast("double")))
    zero = F.struct(first.alias("p"), F.array(F.exp(first)).alias("cdf"))
    return F.aggregate(
        terms,
        zero,
        lambda acc, t: F.struct((acc["p"] + t).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(acc["p"] + t))).alias("cdf")),
        lambda acc: acc["cdf"],
    )


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, size: int | None = None, source: str = "source") -> tuple[DataFrame, float]:
    """(s, n, mean) for each source, from which ``cdf`` follows, and about how many numbers all of these hold."""
    counts = docs.groupBy(F.col(source).alias("s")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.coalesce(*(F.when(F.col("s").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()), F.lit(0.0))
    weighted = counts.withColumn("weight", weight)
    total = weighted.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("sources"), F.coalesce(F.sum(F.sqrt(F.col("weight") / F.col("n"))), F.lit(0.0)).alias("roots")).first()
    asked = total.n if size is None else size
    numbers = 60 * total.sources + 24 * total.roots * (asked / total.w if total.w else 0) ** 0.5
    return weighted.select("s", "n", (F.col("weight") / F.lit(total.w) * F.lit(asked) / F.col("n")).alias("mean")), numbers


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, size: int | None = None, seed: int = 42, source: str = "source", key: str = "doc_id", text: str = "text", most_numbers: int = 2_000_000) -> DataFrame:
    """``docs`` replicated and in a global random order, with copies, copy (from 1) and mix_key."""
    mean, numbers = rates(docs, weights, temperature, size, source)
    table_ = mean.where("mean > 0").select("s", least_copies(F.col("mean")).alias("least"), poisson_cdf(F.col("mean")).alias("cdf"))
    table_ = F.broadcast(table_) if numbers <= most_numbers else table_
    rest = [x for x in docs.columns if x not in ADDED]
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    name = F.concat_ws("|", said(key), F.md5(said(text).cast("binary")))
    drawn = docs.select(F.struct(*(F.col(f"`{x}`") for x in rest)).alias("row"), F.col(f"`{source}`").alias("source"), name.alias("name"))
    drawn = drawn.withColumn("u", uniform(F.lit(str(seed)), F.col("name")))
    passed = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    counted = drawn.join(table_, drawn.source.eqNullSafe(table_.s)).withColumn("copies", F.col("least") + passed)
    copied = counted.where("copies > 0").select("row", "name", "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return copied.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(str(seed + 1)), "name", F.col("copy").cast("string")))).orderBy("mix_key", "copy").select("row.*", *ADDED)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = """
WITH n AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT s, sqrt(CAST(n AS DOUBLE)) / sum(sqrt(CAST(n AS DOUBLE))) OVER () * sum(n) OVER () / n AS mean FROM n),
k AS (SELECT s, mean, unnest(range(0, CAST(ceil(mean + 12 * sqrt(mean) + 25) AS BIGINT) + 1)) AS k FROM w),
p AS (SELECT s, k, exp(-mean + sum(CASE WHEN k = 0 THEN 0 ELSE ln(mean) - ln(k) END) OVER (PARTITION BY s ORDER BY k)) AS p FROM k),
c AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS cdf FROM p),
u AS (SELECT *, CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
d AS (
  SELECT doc_id, text, lang, source, n_chars, (SELECT count(*) FROM c WHERE c.s IS NOT DISTINCT FROM u.source AND c.cdf <= u.u) AS copies FROM u
)
SELECT doc_id, text, lang, source, n_chars, copies, copy, md5('43|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '|' || copy) AS mix_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM d)
"""
