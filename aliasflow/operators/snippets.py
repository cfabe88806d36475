"""Source snippets: who owns each symbol, what happens to it, its placeholder, and the text that comes out of it.

``subjects``: project_id, seq (the order of a project's invocations), doc_id, text, keep_comments, root_package.
``evidence``, a row an occurrence: doc_id, kind (symbol, literal, comment), start, end, name_start, name_end, language,
written, key, role, origin, declared_name, package_name, roots (override roots: key, origin, package, qualified),
qualified, remainder, ticked (kept by choice), stem, field_key, field_name, field_qualified, field_stem, prefix, siblings,
literal_kind, refs (symbols that a literal names: start, end, resolved), verdict (PROSE, CODE), container_start,
container_end, suffix.
``prefixes``: prefix and internal (else third-party).

Everything but the naming itself is columns and joins on the document; naming is one fold over a project's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import capitalised, reserved_words, root_package, splice
from . import naming, policy

#: What a remainder shows instead of its text.
GENERATED = "(generated)"


def _document() -> WindowSpec:
    """Everything about a document is worked out where its rows lie together, without further shuffles."""
    return Window.partitionBy("doc_id")


def _spans(of: Column) -> Column:
    """The spans of a document's rows for which ``of`` holds."""
    return F.collect_list(F.when(of, F.struct("start", "end"))).over(_document())


def _inside(spans: str) -> Column:
    return F.exists(spans, lambda h: (h["start"] <= F.col("start")) & (F.col("end") <= h["end"]))


def strip_comments(rows: DataFrame) -> DataFrame:
    """Evidence with its document's text and keep_comments, without what lies inside a stripped comment; stripped comments
    keep their row, with edit_start and edit_end: how their line closes up."""
    gone = (F.col("kind") == "comment") & ~F.coalesce("keep_comments", F.lit(False))
    held = rows.withColumn("__holes", _spans(gone))
    text = F.col("text")
    before = F.substring_index(F.substring(text, F.lit(1), F.col("start")), "\n", -1)
    after = F.substring_index(F.substring(text, F.col("end") + 1, F.length(text)), "\n", 1)
    layout = policy.comment_strip(before, after)
    blanks = lambda c, pattern: F.length(F.regexp_extract(c, pattern, 0))
    start = F.when(layout == "line", F.col("start") - F.length(before)).when(layout == "preceding blanks", F.col("start") - blanks(before, r"\s*\z")).otherwise(F.col("start"))
    end = F.when(layout == "line", F.least(F.col("end") + F.length(after) + 1, F.length(text))).when(layout == "preceding blanks", F.col("end")).otherwise(F.col("end") + blanks(after, r"^\s*"))
    held = held.withColumn("edit_start", F.when(gone, start)).withColumn("edit_end", F.when(gone, end))
    return held.where(gone | ((F.col("kind") != "comment") & ~_inside("__holes"))).drop("__holes")


def root_packages(subjects: DataFrame, evidence: DataFrame, from_owned_types: bool = False, detect: bool = True) -> DataFrame:
    """(doc_id, roots): the file's root package, or, of traces, those of the types in content; none without detection."""
    if not detect:
        return subjects.select("doc_id", F.array().cast("array<string>").alias("roots"))
    if not from_owned_types:
        return subjects.select("doc_id", F.when(F.col("root_package").isNotNull(), F.array("root_package")).otherwise(F.array().cast("array<string>")).alias("roots"))
    owned = evidence.where("origin = 'IN_CONTENT' and role = 'TYPE' and package_name is not null")
    return owned.groupBy("doc_id").agg(F.array_sort(F.collect_set(root_package(F.col("package_name")))).alias("roots"))


def with_policy(rows: DataFrame, prefixes: DataFrame, from_owned_types: bool = False, detect: bool = True) -> DataFrame:
    """Evidence with its document's root_package, and with shared, shared_qualified, claimed, owned and outcome (replaced or preserved)."""
    internal, third = prefixes.where("internal").select("prefix"), prefixes.where("not internal").select("prefix")
    packages = rows.select(F.explode(F.array_union(F.array("package_name"), F.coalesce(F.transform("roots", lambda r: r["package"]), F.array().cast("array<string>")))).alias("package"))
    lengths = policy.prefix_lengths(packages, internal, third)
    if not detect:
        found = F.array().cast("array<string>")
    elif from_owned_types:
        found = F.collect_set(F.when((F.col("origin") == "IN_CONTENT") & (F.col("role") == "TYPE"), root_package(F.col("package_name")))).over(_document())
    else:
        found = F.filter(F.array("root_package"), lambda x: x.isNotNull())
    out = rows.withColumn("__roots", found).join(lengths.withColumnRenamed("package", "package_name"), "package_name", "left")
    under = lambda package: F.coalesce(F.array_max(F.transform("__roots", lambda r: F.when((package == r) | package.startswith(F.concat(r, F.lit("."))), F.length(r)))), F.lit(-1))
    claimed = F.coalesce(F.greatest(F.coalesce("own", F.lit(-1)), under(F.col("package_name"))) > F.coalesce("other", F.lit(-1)), F.lit(False))
    out = out.withColumn("claimed", claimed).drop("own", "other")
    # override roots are few; their packages' lengths come back as one map a document
    far = rows.select("doc_id", F.explode("roots").alias("r")).select("doc_id", F.col("r.package").alias("package")).where("package is not null").distinct().join(lengths, "package", "left")
    out = out.join(far.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("package", F.struct("own", "other")))).alias("__far")), "doc_id", "left")

    def root_owned(r: Column) -> Column:
        at = F.element_at("__far", r["package"])
        return policy.owned(r["origin"], F.greatest(F.coalesce(at["own"], F.lit(-1)), under(r["package"])) > F.coalesce(at["other"], F.lit(-1)))

    out = out.withColumn("shared", policy.shared_key(F.col("key"), F.col("roots"))).withColumn("shared_qualified", policy.shared_key_qualified(F.col("qualified"), F.col("roots")))
    out = out.withColumn("owned", policy.owned(F.col("origin"), F.col("claimed"))).withColumn("roots_owned", F.forall(F.coalesce("roots", F.array().cast("array<struct<key:string,origin:string,package:string,qualified:boolean>>")), root_owned))
    would = policy.is_anonymized(F.col("origin"), F.col("claimed"), F.col("role"), F.col("package_name"))
    # one constrained occurrence constrains its key in the whole document
    constrained = F.array_contains(F.collect_set(F.when((F.col("kind") != "comment") & policy.is_constrained(), F.col("shared"))).over(_document()), F.col("shared"))
    kept = F.coalesce("ticked", F.lit(False)) & ~F.coalesce("remainder", F.lit(False))
    replaced = (F.col("kind") == "symbol") & would & ~F.coalesce(constrained, F.lit(False)) & ~kept
    return out.withColumn("outcome", F.when(replaced, "replaced").otherwise("preserved")).drop("__roots", "__far")


def anonymize(subjects: DataFrame, evidence: DataFrame, prefixes: DataFrame, from_owned_types: bool = False, detect: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``subjects`` with anonymized; the evidence that policy saw, with outcome and placeholder; and the rows of naming."""
    rows = evidence.join(subjects.select("doc_id", "project_id", "seq", "text", "keep_comments", "root_package"), "doc_id")
    whole = with_policy(strip_comments(rows), prefixes, from_owned_types, detect)
    content = F.substring(F.col("text"), F.col("name_start") + 1, F.col("name_end") - F.col("name_start"))
    cover = policy.literal_coverage(F.col("literal_kind"), F.lit(0), F.length(content), content, F.transform("refs", lambda r: F.struct((r["start"] - F.col("name_start")).alias("start"), (r["end"] - F.col("name_start")).alias("end"), r["resolved"].alias("resolved"))))
    whole = whole.withColumn("coverage", F.when(F.col("kind") == "literal", F.coalesce(cover, F.lit("preserve"))))
    masked = F.coalesce(F.col("coverage") == "str", F.lit(False))
    # symbols inside a literal that becomes one mask go with it
    whole = whole.withColumn("__masks", _spans(masked)).withColumn("covered", (F.col("kind") == "symbol") & _inside("__masks")).drop("__masks")
    drawn = (F.col("outcome") == "replaced") & ~F.col("covered") | masked
    gone = F.struct(F.coalesce("edit_start", "name_start").alias("start"), F.coalesce("edit_end", "name_end").alias("end"))
    whole = whole.withColumn("__removed", F.collect_list(F.when(drawn | F.col("edit_start").isNotNull(), gone)).over(_document()))
    # the words that survive in a text are asked for once, with its first row
    first = F.col("start") == F.min(F.when(drawn, F.col("start"))).over(_document())
    whole = whole.withColumn("__first", first)
    asked = whole.where(drawn).select(
        "project_id", "seq", "start", "field_key", "field_name", "field_qualified", "prefix", "field_stem", "siblings",
        F.when(F.col("__first"), reserved_words(F.col("text"), F.col("__removed"))).alias("reserved"),
        F.when(masked, F.concat(F.lit("literal:"), F.col("start"))).otherwise(F.col("shared")).alias("key"),
        F.when(masked, F.lit("str")).otherwise(policy.namespace(F.col("origin"), F.col("role"))).alias("namespace"),
        F.when(masked, content).otherwise(F.col("declared_name")).alias("original"),
        F.when(masked, F.lit(False)).otherwise(F.col("shared_qualified")).alias("qualified"),
        F.when(F.col("origin") != "UNRESOLVED", F.col("stem")).alias("stem"), masked.alias("literal"),
    )
    named = naming.name_symbols(asked)
    words = named.where("start is not null").select("project_id", "seq", "start", "placeholder", "derived")
    fields = named.select("project_id", "seq", F.col("key").alias("field_key"), F.col("placeholder").alias("__field")).distinct()
    done = whole.drop("__removed", "__first").join(words, ["project_id", "seq", "start"], "left").join(fields, ["project_id", "seq", "field_key"], "left")
    # a property's name, written for its accessor, takes the field's placeholder
    spelt = (F.col("language") == "KOTLIN") & (F.col("written") != F.col("declared_name")) & (F.col("placeholder") == F.concat("prefix", capitalised(F.col("__field"))))
    done = done.withColumn("said", F.concat(F.when(spelt, F.col("__field")).otherwise(F.col("placeholder")), F.coalesce("suffix", F.lit("")))).drop("__field")
    edit = F.when(F.col("edit_start").isNotNull(), F.struct(F.col("edit_start").alias("start"), F.col("edit_end").alias("end"), F.lit("").alias("text"))).when(F.col("placeholder").isNotNull(), F.struct(F.col("name_start").alias("start"), F.col("name_end").alias("end"), F.col("said").alias("text")))
    edits = done.select("doc_id", edit.alias("e")).where("e is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("edits"))
    # a stripped comment's blanks never reach back over what stands before it
    apart = F.transform("edits", lambda e, i: F.struct(F.when(i > 0, F.greatest(e["start"], F.get(F.col("edits"), i - 1)["end"])).otherwise(e["start"]).alias("start"), e["end"].alias("end"), e["text"].alias("text")))
    out = subjects.join(edits.withColumn("edits", apart), "doc_id", "left")
    return out.withColumn("anonymized", F.when(F.col("edits").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("edits")))).drop("edits"), done.drop("text", "keep_comments", "root_package"), named


def unknown_names(done: DataFrame) -> DataFrame:
    """Unresolved identifiers of each document, one a shared key, in order of first occurrence: key, name, placeholder, preservable."""
    rows = done.where("kind = 'symbol' and origin = 'UNRESOLVED' and not covered")
    name = F.when(F.coalesce("remainder", F.lit(False)), F.lit(GENERATED)).otherwise(F.col("declared_name"))
    word = F.when(F.col("outcome") == "replaced", F.col("placeholder"))
    first = rows.groupBy("doc_id", "shared").agg(F.min(F.struct("start", name.alias("name"), word.alias("placeholder"), (~F.coalesce("remainder", F.lit(False))).alias("preservable"))).alias("f"))
    return first.select("doc_id", F.col("shared").alias("key"), "f.*").withColumnRenamed("start", "at")


def comment_counts(done: DataFrame) -> DataFrame:
    """Per document: comments stripped, prose and code, and distinct kept ones in which something was named."""
    some = done.groupBy("doc_id").agg(
        F.count_if(F.col("edit_start").isNotNull() & (F.col("verdict") == "PROSE")).alias("prose"),
        F.count_if(F.col("edit_start").isNotNull() & (F.col("verdict") == "CODE")).alias("code"),
        F.count_distinct(F.when((F.col("kind") != "comment") & F.col("container_start").isNotNull(), F.struct("container_start", "container_end"))).alias("anonymized"),
    )
    return some


def mapping(done: DataFrame) -> DataFrame:
    """What each placeholder of a document stands for, in order of first use; a remainder shows as generated but decodes to its text."""
    rows = done.where("placeholder is not null").withColumn("kind_", policy.mapped_kind(F.col("kind"), F.col("origin"), F.col("role")))
    rest = F.coalesce("remainder", F.lit(False))
    first = rows.groupBy("doc_id", "placeholder").agg(F.min(F.struct("start", F.when(rest, F.lit(GENERATED)).otherwise(F.coalesce("declared_name", "written")).alias("original"), F.coalesce("written", "declared_name").alias("decoding"), F.col("kind_").alias("kind"), rest.alias("remainder"))).alias("f"))
    return first.select("doc_id", "placeholder", F.col("f.start").cast("int").alias("ordinal"), "f.original", "f.decoding", "f.kind", "f.remainder")
