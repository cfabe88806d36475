"""Plans as rows: the status of every text, the spans of those that are read, and their rewritten text.

Recognisers and frames are told by columns over the head of a text; only texts that some reader may take are parsed,
where a plan is one row from its reader to its rewritten text, and each text is parsed once.  Texts are dealt out to all
cores before that, since a small file of keys can make many texts and a file has few parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parts import parts
from ..functions.text import LITERAL, ROLE_PREFIXES
from ..operators.allocation import fold
from ..operators.formats import head_lines, readings
from . import oracle_grid, postgres_text, sqlserver_text, structured
from .expressions import Span
from .frames import Frame
from .postgres_text import Refused

#: Formats with a reader.
READ = ("text", "json", "yaml", "xml", "mysql-json-v1", "mysql-json-v2", "sqlserver-showplan-xml", "sqlserver-showplan-text", "oracle-grid-text", "oracle-sql-monitor-xml")
NAME = "struct<ordinal: int, original: string, placeholder: string, kind: string, key: string>"
ARROW_NAME = pa.list_(pa.struct([("ordinal", pa.int32()), *((x, pa.string()) for x in ("original", "placeholder", "kind", "key"))]))
#: Words that a placeholder could equal.
WORD = re.compile(r"[^\W\d]\w*")
# What to use in place of a form that a reader refuses.
RECOURSE = {"POSTGRES_TEXT_RAW_NAME_ROW": "POSTGRES_FORMAT_JSON", "SQLSERVER_SHOWPLAN_TEXT_REMOTE": "SQLSERVER_SHOWPLAN_XML"}
SPAN = "struct<start: int, end: int, name_start: int, name_end: int, disposition: string, role: string, key: string, unscannable: boolean>"
ARROW_SPAN = pa.list_(pa.struct([*((x, pa.int32()) for x in ("start", "end", "name_start", "name_end")), *((x, pa.string()) for x in ("disposition", "role", "key")), ("unscannable", pa.bool_())]))


#: Readers of what no client frames.
UNFRAMED = {
    "sqlserver-showplan-text": sqlserver_text.parse,
    "oracle-grid-text": oracle_grid.parse,
    **{x: (lambda text, x=x: structured.parse(text, x)) for x in ("sqlserver-showplan-xml", "oracle-sql-monitor-xml")},
}


def spelling_of(text: str) -> str:
    """Of a plan that was taken out of its frame."""
    head = text.lstrip()
    if head.startswith("{"):
        return "mysql-json-v2" if re.match(r'\{\s*"query":', head) else "mysql-json-v1"
    return "json" if head.startswith("[") else "xml" if head.startswith("<explain") else "yaml" if head.startswith("- ") else "text"


def read(text: str, spelling: str | None) -> list[Span]:
    """Spans of a plan, with any client frame around it; raises Refused."""
    if spelling in UNFRAMED:
        return UNFRAMED[spelling](text)
    frame = Frame(text)
    spelling = spelling or spelling_of(frame.text)
    spans = postgres_text.parse(frame.text) if spelling == "text" else structured.parse(frame.text, spelling)
    out = []
    for s in spans:
        whole, name = frame.outer(s.start, s.end), frame.outer(s.name_start, s.name_end)
        if whole is None or name is None:
            raise Refused
        out.append(s._replace(start=whole[0], end=whole[1], name_start=name[0], name_end=name[1]))
    return out


def rewritten(text: str, spans: list[Span], next_number: int = 1) -> tuple[str, list[dict]]:
    """The text with numbered placeholders for its names and values, without what is dropped; and its names in order."""
    edits = [s for s in spans if s.disposition != "preserve"]
    first: dict[str, Span] = {}
    for s in edits:
        if s.key:
            first.setdefault(s.key, s)
    kept, at = [], 0
    for s in edits:
        kept.append((at, s.name_start))
        at = s.name_end
    kept.append((at, len(text)))
    # a word survives if its first character does
    gone = iter([(b, c) for (_, b), (c, _) in zip(kept, kept[1:], strict=False)] + [(len(text) + 1, len(text) + 1)])
    low, high = next(gone)
    taken = set()
    for m in WORD.finditer(text):
        while m.start() >= high:
            low, high = next(gone)
        if not low <= m.start():
            taken.add(m[0])
    prefix = lambda s: ROLE_PREFIXES.get(s.role or "", LITERAL)
    words = {k: w for k, _, w in fold([(k, prefix(s)) for k, s in first.items()], taken, next_number)}
    out, at = [], 0
    for s in edits:
        begin, end = (s.start, s.end) if s.disposition == "drop" else (s.name_start, s.name_end)
        out += [text[at:begin], words.get(s.key or "", "")]
        at = end
    names = [{"ordinal": i, "original": text[s.name_start : s.name_end], "placeholder": words[k], "kind": s.role or "LITERAL", "key": k} for i, (k, s) in enumerate(first.items())]
    return "".join([*out, text[at:]]), names


def _runner(next_number: int, detailed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spelling, taken in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                try:
                    if not taken:
                        rows.append((None, [], None, None, []))
                        continue
                    spans = read(text or "", spelling)
                    done, names = rewritten(text or "", spans, next_number)
                    rows.append((done, names, "read", None, [s._asdict() for s in spans]) if detailed else (done, [], "read", None, []))
                except Refused as e:
                    rows.append((None, [], "refused" if e.form else "unreadable", e.form, []))
            done, names, status, form, spans = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(done, pa.string()), pa.array(names, ARROW_NAME), pa.array(status, pa.string()), pa.array(form, pa.string()), pa.array(spans, ARROW_SPAN)],
                ["row", "text", "anonymized", "names", "status", "form", "spans"],
            )

    return run


def is_framed(lines: Column) -> Column:
    """The first of a text's head lines is that of a client's frame."""
    head = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return (F.trim(head) == "QUERY PLAN") | head.rlike(r"^\*{3,} 1\. row \*{3,}$")


ADDED = ["format", "status", "form", "recourse", "anonymized", "names", "spans"]


def read_plans(subjects: DataFrame, text: str = "text", next_number: int = 1, detailed: bool = True) -> DataFrame:
    """``subjects``, every row of them, with format, status (read, refused, unreadable), form, recourse, spans in document
    order, names and the anonymized text; the last three are empty of what is not read, and hold no text of it.  Unless
    ``detailed``, spans and names are empty throughout."""
    rest = [F.col(f"`{c}`") for c in subjects.columns if c not in (text, *ADDED)]
    # no filter by what is worked out here: it would be worked out again for the filter, and before the texts are dealt
    texts = subjects.select(F.struct(*rest).alias("row"), F.col(f"`{text}`").alias("text"))
    lined = texts.repartition(parts(texts)).withColumn("__lines", head_lines(F.col("text"), 4))
    known = readings(lined.withColumn("framed", F.coalesce(is_framed(F.col("__lines")), F.lit(False))), lines="__lines")
    taken = F.coalesce(F.col("format").isin(*READ), F.lit(False)) | F.col("framed")
    asked = known.select(F.struct("row", "format", "status", "form", "recourse", taken.alias("taken")).alias("row"), "text", F.when(~F.col("framed"), F.col("format")).alias("spelling"), taken.alias("taken"))
    schema = T.StructType([*asked.schema.fields[:2], *T.StructType.fromDDL(f"anonymized string, names array<{NAME}>, status string, form string, spans array<{SPAN}>")])
    recourse = F.coalesce(*(F.when(F.col("form") == k, F.lit(v)) for k, v in RECOURSE.items()))
    of = lambda said, name: F.when(F.col("row.taken"), said).otherwise(F.col(f"row.{name}")).alias(name)
    return asked.mapInArrow(_runner(next_number, detailed), schema).select(
        "row.row.*", F.col("text").alias(text), "row.format", of(F.col("status"), "status"), of(F.col("form"), "form"), of(recourse, "recourse"), "anonymized", "names", "spans"
    )


def parse_plans(subjects: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a span, or one with its status where there is none."""
    return read_plans(subjects.select(key, text), text).select(key, "format", "status", "form", "recourse", F.explode_outer("spans").alias("s")).select(key, "format", "status", "form", "recourse", "s.*")


def plan_names(subjects: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a name of the plans that are read, in order of first use."""
    return read_plans(subjects.select(key, text), text).select(key, F.explode("names").alias("n")).select(key, "n.*")


def plan_counts(subjects: DataFrame, preserved_keys: tuple[str, ...] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per plan that is read: distinct keys replaced; distinct keys kept by choice, and distinct spellings preserved."""
    plans = read_plans(subjects.select(key, text), text).where("status = 'read'")
    keys = F.array_distinct(F.transform(F.filter("spans", lambda s: s["disposition"] == "anonymize"), lambda s: s["key"]))
    ticked = F.array_intersect(keys, F.array(*map(F.lit, preserved_keys)).cast("array<string>"))
    spelt = F.array_distinct(F.transform(F.filter("spans", lambda s: s["disposition"] == "preserve"), lambda s: F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])))
    return plans.select(key, F.size(F.array_except(keys, ticked)).cast("long").alias("replaced"), (F.size(ticked) + F.size(spelt)).cast("long").alias("preserved"))


def anonymize_plans(subjects: DataFrame, next_number: int = 1) -> DataFrame:
    """``subjects`` that are read, with their names and values replaced by numbered placeholders."""
    done = read_plans(subjects, next_number=next_number, detailed=False).where("status = 'read'")
    return done.select(*((F.col("anonymized") if c == "text" else F.col(f"`{c}`")).alias(c) for c in subjects.columns))
