"""Counts, notices and corpus-scale reports, all of them aggregates of names, words and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_record, names, words


def name_counts(evidence: DataFrame) -> DataFrame:
    """Per document: distinct shared keys replaced, preserved and unknown (unresolved, whatever became of them), and unknown only in comments."""
    groups = evidence.groupBy("doc_id", "shared").agg(
        F.max(F.col("origin") == "UNRESOLVED").alias("unknown"),
        F.max(F.col("outcome") == "replaced").alias("replaced"),
        F.min(F.col("in_comment")).alias("only_comment"),
    )
    count = lambda c: F.count_if(c)
    return groups.groupBy("doc_id").agg(
        count(F.col("replaced") & ~F.col("unknown")).alias("replaced"),
        count(F.col("unknown")).alias("unknown"),
        count(~F.col("replaced") & ~F.col("unknown")).alias("preserved"),
        count(F.col("unknown") & F.col("only_comment")).alias("unknown_from_comments"),
    )


def flattened(names: DataFrame) -> DataFrame:
    """Originals of a document that several placeholders stand for; literals and remainders do not count."""
    some = names.where("placeholder is not null and kind != 'LITERAL' and not remainder")
    many = some.groupBy("doc_id", "original").agg(F.array_sort(F.collect_list(F.struct("ordinal", "placeholder"))).alias("p")).where(F.size("p") > 1)
    return many.select("doc_id", "original", F.transform("p", lambda x: x["placeholder"]).alias("placeholders"))


def notices(flat: DataFrame, comments: DataFrame) -> DataFrame:
    """Per document at most two sentences, in order: names that were the same, and how many comments were stripped."""
    listed = F.concat(F.array_join(F.slice("placeholders", 1, F.size("placeholders") - 1), ", "), F.lit(" and "), F.element_at("placeholders", -1), F.lit(" were the same name"))
    same = flat.select("doc_id", "original", listed.alias("said")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("original", "said"))), lambda x: x["said"]), "; ").alias("same"))
    n = F.col("prose") + F.col("code")
    stripped = comments.where(n > 0).select("doc_id", F.concat(n.cast("string"), F.when(n == 1, " comment").otherwise(" comments"), F.lit(" stripped")).alias("stripped"))
    both = same.join(stripped, "doc_id", "full")
    return both.select("doc_id", F.filter(F.array("same", "stripped"), lambda x: x.isNotNull()).alias("notices"))


def counts_text(counts: DataFrame, subject: str = "SNIPPET", balloon: bool = False, expanded: Column | None = None) -> DataFrame:
    """``counts`` (replaced, unknown, unknown_from_comments, preserved, comments_anonymized) with said: the line a preview or a balloon shows."""
    comments = F.col("comments_anonymized")
    unknown = F.concat(F.col("unknown").cast("string"), F.lit(" unknown"), F.when(F.col("unknown_from_comments") > 0, F.concat(F.lit(" ("), F.col("unknown_from_comments").cast("string"), F.lit(" from comments)"))).otherwise(""))
    parts = [F.concat(F.col("replaced").cast("string"), F.lit(" names replaced" if balloon else " renamed"))]
    parts += [] if subject == "PLAN" else [unknown]
    parts.append(F.concat(F.col("preserved").cast("string"), F.lit(" preserved")))
    if subject == "SNIPPET":
        parts.append(F.when(comments > 0, F.concat(comments.cast("string"), F.when(comments == 1, " comment").otherwise(" comments"), F.lit(" anonymized"))))
        parts += [] if balloon or expanded is None else [F.when(expanded, "selection expanded to whole tokens")]
    return counts.withColumn("said", F.concat_ws(" · ", *parts))


def rename_status(names: DataFrame, ledger: DataFrame) -> DataFrame:
    """NONE without a placeholder or for unknowns, ESTABLISHED if the ledger has the key, DERIVED for accessors, else OFFERED."""
    has = ledger.select("project_id", "key", F.lit(True).alias("__has"))
    status = F.when(F.col("placeholder").isNull() | (F.col("kind") == "UNKNOWN"), "NONE").when(F.col("__has"), "ESTABLISHED").when(F.col("derived"), "DERIVED").otherwise("OFFERED")
    return names.join(has, ["project_id", "key"], "left").withColumn("renaming", status).drop("__has")


def mapping_csv(names: DataFrame) -> DataFrame:
    """One text a document: a header and a record a placeholder, in order of first use; every record ends with CRLF."""
    lines = F.array_sort(F.collect_list(F.struct("ordinal", csv_record(F.col("placeholder"), F.col("original"), F.col("kind")).alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "")
    return names.where("placeholder is not null").groupBy("doc_id").agg(F.concat(F.lit("Placeholder,Original,Kind\r\n"), body).alias("csv"))


def survivors(subjects: DataFrame, by: str = "doc_id") -> DataFrame:
    """Words of ``text`` that ``output`` still holds, with the first line of it (from 0) that does.

    Each line is cut to the words of its own text before anything is shuffled.
    """
    universe = subjects.select(by, F.array_distinct(words(F.col("text"))).alias("universe"), F.split("output", "\n", -1).alias("lines"))
    lines = universe.select(by, "universe", F.posexplode("lines").alias("line", "l"))
    found = lines.select(by, "line", F.explode(F.array_intersect("universe", words(F.col("l")))).alias("word"))
    return found.groupBy(by, "word").agg(F.min("line").alias("line"))


def coverage(formats: DataFrame, captures: DataFrame) -> DataFrame:
    """Captures for every format of the catalogue, those without any too."""
    counts = captures.groupBy("format").agg(F.count("*").alias("n"))
    return formats.join(counts, formats.name == counts.format, "left").select("engine", "name", "state", F.coalesce("n", F.lit(0)).alias("captures"))


def starved(formats: DataFrame, captures: DataFrame) -> DataFrame:
    """Admitted formats without a capture."""
    return coverage(formats, captures).where("state = 'admitted' and captures = 0").select("name")


def default_form_share(formats: DataFrame) -> DataFrame:
    """Per engine: how many of its formats are admitted, and of those reached by default."""
    return formats.groupBy("engine").agg(
        F.count("*").alias("formats"),
        F.count_if(F.col("state") == "admitted").alias("admitted"),
        F.count_if((F.col("state") == "admitted") & (F.col("reach") == "default")).alias("by_default"),
    )


def capture_verdicts(captures: DataFrame) -> DataFrame:
    """(label, status, form) against what the label promises: right, refused_admitted, read_refused or wrong_message."""
    promised = F.when(F.col("label").startswith("refusal-"), F.substring("label", F.lit(9), F.length("label")))
    verdict = (
        F.when(promised.isNull(), F.when(F.col("status") == "read", "right").otherwise("refused_admitted"))
        .when(F.col("status") == "read", "read_refused")
        .when(F.lower(F.replace(F.coalesce("form", F.lit("")), F.lit("_"), F.lit("-"))) == promised, "right")
        .otherwise("wrong_message")
    )
    return captures.withColumn("verdict", verdict).groupBy("verdict").agg(F.count("*").alias("n"))


def redaction_rate(fields: DataFrame) -> DataFrame:
    """Per format: captures with an unscannable field, fields, and unscannable fields."""
    return fields.groupBy("format").agg(F.countDistinct(F.when(F.col("unscannable"), F.col("doc_id"))).alias("captures"), F.count("*").alias("fields"), F.count_if("unscannable").alias("unscannable"))


def preserve_counts(occurrences: DataFrame) -> DataFrame:
    return occurrences.where("disposition = 'preserve'").groupBy("spelling").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "spelling")


def two_way_spellings(spellings: DataFrame) -> DataFrame:
    """Names that are written in several ways, once folded to lower case."""
    # distinct first: a hash aggregate of words leaves little for the lists
    distinct = spellings.select("spelling").distinct()
    return distinct.groupBy(F.lower("spelling").alias("folded")).agg(F.array_sort(F.collect_list("spelling")).alias("ways")).where(F.size("ways") > 1)


def outside_vocabulary(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return words.join(vocabulary.select("word").distinct(), "word", "left_anti").groupBy("word").agg(F.count("*").alias("n"))


def provenance(fixtures: DataFrame, vocabulary: DataFrame, printer: DataFrame) -> DataFrame:
    """Identifiers of fixtures (name, text) that neither the fixed vocabulary nor a printer's words hold, with the fixture."""
    each = fixtures.select("name", F.explode(F.array_distinct(names(F.col("text")))).alias("word"))
    known = vocabulary.select("word").union(printer.select("word")).distinct()
    return each.join(known, "word", "left_anti").groupBy("name", "word").agg(F.count("*").alias("n"))


def source_gate(files: DataFrame, kotlin: bool = True, plugin: bool = True) -> DataFrame:
    """Files (path) with offered, and refusal where a language is known but cannot be read; others are absent."""
    extension = F.lower(F.when(F.element_at(F.split("path", "/"), -1).contains("."), F.substring_index("path", ".", -1)).otherwise(""))
    some = files.withColumn("extension", extension).where(F.col("extension").isin("java", "kt"))
    refusal = F.when((F.col("extension") == "kt") & F.lit(not kotlin), "PATH_NOT_ACTIVATED" if plugin else "PLUGIN_NOT_RUNNING")
    return some.withColumn("refusal", refusal).withColumn("offered", refusal.isNull())


def host_ranges(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """Ranges (doc_id, start, end) of an injected text in its host's offsets, where one segment (doc_id, inner_start,
    inner_end, host_start, host_end) holds all of a range and neither is an escape; others have no host range."""
    plain = (F.col("inner_end") - F.col("inner_start")) == (F.col("host_end") - F.col("host_start"))
    within = segments.where(plain).groupBy("doc_id").agg(F.collect_list(F.struct("inner_start", "inner_end", "host_start")).alias("__s"))
    hit = F.get(F.filter("__s", lambda s: (s["inner_start"] <= F.col("start")) & (F.col("end") <= s["inner_end"])), F.lit(0))
    out = ranges.join(within, "doc_id", "left").withColumn("__h", hit)
    shift = F.col("__h.host_start") - F.col("__h.inner_start")
    return out.withColumn("host_from", F.col("start") + shift).withColumn("host_to", F.col("end") + shift).drop("__s", "__h")


def merged_fragments(fragments: DataFrame, by: str = "doc_id") -> DataFrame:
    """Ranges (start, end) that touch or overlap, merged; gaps and islands a document.  Missing ends come last."""
    w = Window.partitionBy(by).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = fragments.withColumn("reach", reach).withColumn("island", island)
    return marked.groupBy(by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def source_spellings(members: DataFrame) -> DataFrame:
    """Every way a member of (class_name, member, role, file_stem, module, and jvm_name if it is there) may be written elsewhere."""
    cap = F.concat(F.upper(F.substring("member", 1, 1)), F.substring("member", F.lit(2), F.length("member")))
    low = lambda n: F.concat(F.lower(F.substring("member", n + 1, 1)), F.substring("member", F.lit(n + 2), F.length("member")))
    ways = F.array(
        F.col("member"),
        F.when(F.col("role") == "FIELD", F.concat(F.lit("get"), cap)),
        F.when(F.col("role") == "FIELD", F.concat(F.lit("set"), cap)),
        F.when((F.col("role") == "FIELD") & F.col("member").startswith("is"), F.concat(F.lit("set"), F.substring("member", F.lit(3), F.length("member")))),
        F.when((F.col("role") == "METHOD") & F.col("member").rlike(r"^get\p{Lu}"), low(3)),
        F.when((F.col("role") == "METHOD") & F.col("member").rlike(r"^set\p{Lu}"), low(3)),
        F.when(F.col("file_stem").isNotNull(), F.concat(F.col("file_stem"), F.lit("Kt"))),
        F.when(F.col("role") == "TYPE", F.concat(F.col("member"), F.lit(".INSTANCE"))),
        F.when((F.col("role") == "METHOD") & F.col("module").isNotNull(), F.concat("member", F.lit("$"), "module")),
        F.col("jvm_name") if "jvm_name" in members.columns else F.lit(None).cast("string"),
    )
    return members.withColumn("spelling", F.explode(F.array_distinct(F.filter(ways, lambda x: x.isNotNull()))))
