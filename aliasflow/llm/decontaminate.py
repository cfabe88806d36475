"""Benchmark decontamination by a broadcast hash set of normalised test n-grams, in built-in functions only.

Words are maximal runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased.  The windows of an item are its
runs of ``size`` consecutive words; an item of fewer words, but not none, is one window.  A scan over each document's
words looks up a hash of three words of every window in the set of test windows.  Only windows found there, of the few
documents that hold any, are joined with the windows themselves, which verifies them word by word.

* The set holds the benchmark's hashes only: up to ``most_windows`` of them as they are, and more as a table of bits of
  fixed size.  The windows are broadcast for the join only if they and their items take ``most_bytes`` or less.  Neither
  changes the result.
* A null text has no words: such a document has no hit, such an item no window.  A null item_id counts as ''.
* Each row of the documents gives one row, whatever its key: a row is told by its key, which may be null, and its text.
* Columns of documents that bear other names than key and text are not read by :func:`contamination`, and are kept, as
  are key and text, by :func:`decontaminate`.  An empty benchmark or no documents give no hit or no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, split_words, stored, table, text_hash

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words after lower-casing, and before it.
BETWEEN, CASED_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bits of the table that stands for hashes beyond the exact set.
SLOTS = 1 << 23


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN)


def _probe(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.element_at(words, at + i) for i in sorted({0, length // 2, length - 1})))


def _starts(words: Column, length: int) -> Column:
    last = F.size(words) - F.lit(length - 1)
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _hits(words: Column, length: int, known: Callable[[Column], Column]) -> Column:
    """The windows of a document whose probes are known."""
    starts = F.filter(_starts(words, length), lambda i: known(_probe(words, i, length)))
    return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(length).alias("length"), F.array_join(F.slice(words, i, length), " ").alias("gram")))


def _known(windows: DataFrame, most_windows: int) -> dict[int, Callable[[Column], Column]]:
    """For each length of window: whether a probe is in the set."""
    lengths = [r.length for r in windows.select("length").distinct().orderBy("length").collect()]  # at most as many as a window has words
    exact = windows.select("length", "probe").distinct().limit(most_windows + 1).collect()
    if len(exact) <= most_windows:
        return {n: (lambda p, own=[r.probe for r in exact if r.length == n]: p.isin(own)) for n in lengths}
    slot = F.pmod("probe", F.lit(SLOTS))
    rows = windows.groupBy(F.floor(slot / 64).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits")).collect()  # SLOTS / 64 at most
    bits = ["0"] * (SLOTS // 64)
    for r in rows:
        bits[r["at"]] = str(r.bits)
    table_ = F.split(F.lit(",".join(bits)), ",").cast("array<bigint>")  # folded into one literal

    def known(p: Column) -> Column:
        s = F.pmod(p, F.lit(SLOTS))
        return F.getbit(F.get(table_, F.floor(s / 64).cast("int")), (s % 64).cast("int")) == 1

    return dict.fromkeys(lengths, known)


def windows_of(benchmark: DataFrame, size: int, text: str = "text", key: str = "item_id") -> DataFrame:
    """(length, gram, probe, items) for each distinct window of the items."""
    item = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    item = item.withColumn("length", F.least(F.size("w"), F.lit(size)))
    at = item.select("item", "w", "length", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("i"))
    cases = F.coalesce(*(F.when(F.col("length") == n, _probe(F.col("w"), F.col("i"), n)) for n in range(1, size + 1)))
    gram = at.select("item", "length", F.array_join(F.slice("w", F.col("i"), F.col("length")), " ").alias("gram"), cases.alias("probe"))
    return gram.groupBy("gram").agg(F.first("length").alias("length"), F.first("probe").alias("probe"), F.collect_set("item").alias("items"))


def _covered(spans: Column) -> Column:
    """Number of words inside any of the spans, which are in order of their starts."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["i"] + s["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["i"] + s["length"] - F.greatest(acc["end"], s["i"]))).cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_windows: int = 100_000, most_bytes: int = 32_000_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, spans (first word from 1, length; in order), items (sorted ids)."""
    return _contamination(docs, benchmark, size, most_windows, most_bytes, text, key).select(F.col("k").alias(key), "n_words", "n_hit", "spans", "items")


def _contamination(docs: DataFrame, benchmark: DataFrame, size: int, most_windows: int, most_bytes: int, text: str, key: str) -> DataFrame:
    windows = stored(windows_of(benchmark, size), "windows")
    scan = docs.select(F.col(f"`{key}`").alias("k"), text_hash(text).alias("same"), words_of(F.col(f"`{text}`")).alias("w"))
    found = [_hits(F.col("w"), n, known) for n, known in _known(windows, most_windows).items()]
    none = F.array().cast("array<struct<i:int,length:int,gram:string>>")
    scan = stored(scan.select("k", "same", F.size("w").cast("long").alias("n_words"), (F.concat(*found) if found else none).alias("hits")), "hits")
    held = windows.agg(F.sum(F.octet_length("gram") + F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + 16 + F.octet_length(x)) + 40)).first()[0] or 0
    table_ = windows.select(F.col("gram").alias("g"), F.col("length").alias("l"), "items")
    table_ = F.broadcast(table_) if held <= most_bytes else table_
    each = scan.where(F.size("hits") > 0).select("k", "same", "hits").dropDuplicates(["k", "same"]).select("k", "same", F.explode("hits").alias("hit"))
    joined = each.join(table_, (each.hit.gram == table_.g) & (each.hit.length == table_.l))
    span = F.struct(F.col("hit.i").alias("i"), F.col("hit.length").alias("length"))
    told = joined.groupBy(F.col("k").alias("hk"), F.col("same").alias("hs")).agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = scan.select("k", "same", "n_words").join(told, F.col("k").eqNullSafe(F.col("hk")) & (F.col("same") == F.col("hs")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<i:int,length:int>>"))
    return out.select("k", "same", "n_words", _covered(spans).alias("n_hit"), spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def cut_spans(text: Column, spans: Column) -> Column:
    """A text without the words of the spans; what stands before each kept word, and after the last, stays."""
    text = F.coalesce(text, F.lit(""))
    words, gaps = split_words(text, CASED_BETWEEN), F.split(text, CASED_WORD, -1)
    hit = lambda i: F.exists(spans, lambda s: (i + 1 >= s["i"]) & (i + 1 < s["i"] + s["length"]))
    kept = F.transform(F.arrays_zip(words.alias("w"), gaps.alias("g")), lambda x, i: F.when(x["w"].isNull(), x["g"]).when(hit(i), F.lit("")).otherwise(F.concat(x["g"], x["w"])))
    return F.array_join(kept, "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = 10, most_windows: int = 100_000, most_bytes: int = 32_000_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with contaminated documents dropped, or with the hit words cut out of them (``remove='spans'``)."""
    hit = _contamination(docs, benchmark, size, most_windows, most_bytes, text, key).where("n_hit > 0")
    hit = hit.select(F.col("k").alias("hk"), F.col("same").alias("hs"), "spans").dropDuplicates(["hk", "hs"])
    rows = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), F.col(f"`{key}`").alias("k"), text_hash(text).alias("same"))
    match = F.col("k").eqNullSafe(F.col("hk")) & (F.col("same") == F.col("hs"))
    if remove == "documents":
        return rows.join(hit.drop("spans"), match, "left_anti").select("row.*")
    whole = F.col(f"row.`{text}`")
    cut = F.when(F.col("spans").isNull(), whole).otherwise(cut_spans(whole, F.col("spans")))
    return rows.join(hit, match, "left").select(*((cut if x == text else F.col(f"row.`{x}`")).alias(x) for x in docs.columns))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH item AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM item)
), doc AS (SELECT doc_id, {_WORDS} AS w FROM documents
), spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM grams))
), hits AS (SELECT doc_id, i, spots.n, item_id FROM spots JOIN grams USING (n, gram)
), covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
