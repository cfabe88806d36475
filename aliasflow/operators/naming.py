"""Naming the symbols of source snippets in the order of a project's invocations.

This is the one step that is sequential by nature: a number drawn in one invocation is never drawn again in the next.
Only new keys matter to it; what the ledger holds is looked up.  Rules on top of the plain counter:

* An accessor of a field takes its name from the field's, which is named first even if it was not seen; if that word
  survives in the text, the accessor draws a number of its own.
* Accessors of a named field that were not seen get rows as well, without drawing numbers, unless they are known,
  unqualified, not to be replaced, or their word is taken.
* A chosen stem replaces a namespace; stems that were used, or that accessors derive from used ones, are recorded.
* A literal draws a number of its own each time.
* Qualified keys are kept; unqualified ones are forgotten after their invocation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parts import parts
from ..functions.text import LITERAL, ROLE_PREFIXES


@dataclass
class Ledger:
    """What a project keeps: placeholders and originals by key, the counter, the stems that were used.

    A stream keeps the same in keyed state and gives another class with these methods.
    """

    number: int = 1
    names: dict[str, tuple[str, str]] = field(default_factory=dict)
    stems: set[str] = field(default_factory=set)

    def word_of(self, key: str) -> str | None:
        return self.names[key][0] if key in self.names else None

    def holds(self, word: str) -> bool:
        return any(w == word for w, _ in self.names.values())

    def after(self, run: "Run") -> "Ledger":
        """Append-only: a key that is there keeps its row; the counter moves and stems unite."""
        return Ledger(run.number, {**run.fresh, **self.names}, self.stems | run.stems)


class Growing(Ledger):
    """A ledger that is changed in place: an invocation costs what it adds, however long the history."""

    def __init__(self, number: int = 1, names: dict[str, tuple[str, str]] | None = None, stems: Iterable[str] = ()) -> None:
        super().__init__(number, dict(names or {}), set(stems))
        self.held = {w for w, _ in self.names.values()}

    def holds(self, word: str) -> bool:
        return word in self.held

    def after(self, run: "Run") -> "Growing":
        for key, named in run.fresh.items():
            if self.names.setdefault(key, named) is named:
                self.held.add(named[0])
        self.number = run.number
        self.stems |= run.stems
        return self


@dataclass(slots=True)
class Symbol:
    key: str
    namespace: str
    original: str
    qualified: bool = True
    field_key: str | None = None
    field_name: str | None = None
    field_qualified: bool = True
    prefix: str | None = None
    stem: str | None = None
    field_stem: str | None = None
    literal: bool = False
    siblings: list["Symbol"] = field(default_factory=list)


NUMBER = re.compile(r"\d+$")


def derived(prefix: str, placeholder: str) -> str:
    return prefix + placeholder[:1].upper() + placeholder[1:]


class Run:
    """One invocation over a ledger; ``reserved`` are the words that survive in its text."""

    def __init__(self, ledger: Ledger, reserved: Iterable[str]) -> None:
        self.ledger, self.reserved, self.number = ledger, frozenset(reserved), ledger.number
        self.words: dict[str, str] = {}
        self.fresh: dict[str, tuple[str, str]] = {}
        self.derived: set[str] = set()
        self.stems: set[str] = set()

    def word_of(self, key: str) -> str | None:
        """The word that a key has in this invocation, or had before it."""
        if (word := self.words.get(key)) is None and (word := self.ledger.word_of(key)) is not None:
            self.words[key] = word
        return word

    def draw(self, namespace: str, stem: str | None = None) -> str:
        if stem:
            self.stems.add(stem)
        while True:
            word = f"{stem or namespace}{self.number}"
            self.number += 1
            if word not in self.reserved:
                return word

    def _derive(self, of: str, word: str) -> str:
        """An accessor's word; its stem is recorded if its field's was chosen."""
        if (self.stems or self.ledger.stems) and ((stem := NUMBER.sub("", of)) in self.stems or stem in self.ledger.stems):
            self.stems.add(NUMBER.sub("", word))
        return word

    def name(self, s: Symbol) -> str:
        if s.literal:
            return self.draw(LITERAL)
        if (word := self.word_of(s.key)) is not None:
            return word
        if s.prefix and s.field_key:
            if (of := self.word_of(s.field_key)) is None:
                self.words[s.field_key] = of = self.draw(ROLE_PREFIXES["FIELD"], s.field_stem)
                if s.field_qualified:
                    self.fresh[s.field_key] = (of, s.field_name or "")
            if (made := derived(s.prefix, of)) not in self.reserved:
                word = self._derive(of, made)
                self.derived.add(s.key)
        self.words[s.key] = word = word or self.draw(s.namespace, s.stem)
        if s.qualified:
            self.fresh[s.key] = (word, s.original)
        return word

    def siblings(self, seen: Iterable[Symbol]) -> None:
        near = [x for y in seen if y.siblings for x in y.siblings]
        held = set(self.words.values()) if near else set()
        for s in near:
            if not s.prefix or not s.field_key or self.word_of(s.field_key) is None or self.word_of(s.key) is not None or not s.qualified:
                continue
            word = derived(s.prefix, self.words[s.field_key])
            if word in self.reserved or word in held or self.ledger.holds(word):
                continue
            self.words[s.key] = self._derive(self.words[s.field_key], word)
            self.fresh[s.key] = (word, s.original)
            held.add(word)


def _run(ledger: Ledger, symbols: list[Symbol], reserved: Iterable[str] | None) -> tuple[Run, list[str], Ledger]:
    """An invocation, the placeholder of each symbol in document order, and the ledger after it."""
    run = Run(ledger, reserved if reserved is not None else ())
    words = [run.name(s) for s in symbols]
    run.siblings(symbols)
    return run, words, ledger.after(run)


def invocation(ledger: Ledger, symbols: list[Symbol], reserved: Iterable[str]) -> tuple[list[tuple[str, str]], Ledger, set[str]]:
    """(key, placeholder) of each symbol in document order, the ledger after it, and the keys that were derived."""
    run, words, ledger = _run(ledger, symbols, reserved)
    return [(s.key, word) for s, word in zip(symbols, words, strict=True)], ledger, run.derived


SIBLING = "struct<key: string, original: string, prefix: string, field_key: string, qualified: boolean>"
#: What naming asks of a symbol; columns that are missing count as null.
EVIDENCE = {
    "project_id": "string", "seq": "long", "start": "int", "key": "string", "namespace": "string", "original": "string", "qualified": "boolean",
    "field_key": "string", "field_name": "string", "field_qualified": "boolean", "prefix": "string", "stem": "string", "field_stem": "string",
    "literal": "boolean", "siblings": f"array<{SIBLING}>", "reserved": "array<string>",
}
ROW = "project_id string, seq long, start int, key string, placeholder string, original string, derived boolean, sibling boolean, fresh boolean, next_number int, stems array<string>"
HEAD = "project_id string, next_number int, stems array<string>"


def _given(x: object) -> bool:
    return x is not None and x == x


def symbols_of(rows: pd.DataFrame) -> list[Symbol]:
    """The symbols of one invocation, in document order."""
    text = lambda x: x if _given(x) else None
    out = []
    for r in rows.itertuples(index=False):
        siblings = [Symbol(y["key"], "", y["original"], bool(y["qualified"]), y["field_key"], None, True, y["prefix"]) for y in (r.siblings if r.siblings is not None else [])]
        out.append(Symbol(r.key, r.namespace, r.original, bool(r.qualified), text(r.field_key), text(r.field_name), not _given(r.field_qualified) or bool(r.field_qualified), text(r.prefix), text(r.stem), text(r.field_stem), _given(r.literal) and bool(r.literal), siblings))
    return out


def _name_run(out: list[tuple], ledger: Ledger, project: str | None, seq: int | None, starts: Iterable, symbols: list[Symbol], reserved: Iterable[str] | None) -> Ledger:
    """Appends the rows of ROW for one invocation; the ledger after it."""
    run, words, ledger = _run(ledger, symbols, reserved)
    seen = {s.key for s in symbols}
    head = (run.number, sorted(run.stems))
    for start, s, word in zip(starts, symbols, words, strict=True):
        out.append((project, seq, start, s.key, word, s.original, s.key in run.derived, False, s.key in run.fresh, *head))
    if not run.fresh.keys() <= seen:  # fields that accessors name first, and accessors that were not seen
        originals = {y.key for s in symbols for y in s.siblings}
        for key, (word, original) in run.fresh.items():
            if key not in seen:
                out.append((project, seq, None, key, word, original, key in originals, key in originals, True, *head))
    return ledger


def name_runs(rows: pd.DataFrame, ledger: Ledger) -> tuple[list[tuple], Ledger]:
    """Rows of ROW for the invocations of one project, in their order, and the ledger after them."""
    out: list[tuple] = []
    for seq, part in rows.sort_values(["seq", "start"], kind="stable").groupby("seq", sort=True, dropna=False):
        ledger = _name_run(out, ledger, part["project_id"].iloc[0], seq if _given(seq) else None, part["start"], symbols_of(part), part["reserved"].iloc[0])
    return out, ledger


def _symbol(row: tuple) -> Symbol:
    """Of a row of EVIDENCE."""
    _, _, _, key, namespace, original, qualified, field_key, field_name, field_qualified, prefix, stem, field_stem, literal, siblings, _ = row
    near = [Symbol(y["key"], "", y["original"], bool(y["qualified"]), y["field_key"], None, True, y["prefix"]) for y in siblings] if siblings else []
    return Symbol(key, namespace, original, bool(qualified), field_key, field_name, field_qualified is None or field_qualified, prefix, stem, field_stem, bool(literal), near)


def _values(column: pa.Array) -> list:
    """As to_pylist makes them; words and truths go through NumPy, which takes a fraction of the time."""
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) or pa.types.is_boolean(column.type) else column.to_pylist()


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of EVIDENCE; columns that a batch lacks are null."""
    for batch in batches:
        had = dict(zip(batch.schema.names, batch.columns, strict=True))
        none = [None] * batch.num_rows
        yield from zip(*(_values(had[k]) if k in had else none for k in EVIDENCE), strict=True)


def _name_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROW of EVIDENCE that lies sorted by project, invocation and start; only a ledger and an invocation are held."""
    out: list[tuple] = []
    for project, history in groupby(_rows(batches), itemgetter(0)):
        ledger = Growing()
        for seq, rows in groupby(history, itemgetter(1)):
            held = list(rows)
            ledger = _name_run(out, ledger, project, seq, [r[2] for r in held], [_symbol(r) for r in held], held[0][-1])
            if len(out) >= 20000:
                yield _batch(out, ARROW_ROW)
                out = []
    if out:
        yield _batch(out, ARROW_ROW)


def _heads_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """HEAD of the same rows: the same fold, of which only the end of each history is written."""
    out: list[tuple] = []
    for project, history in groupby(_rows(batches), itemgetter(0)):
        ledger = Growing()
        for _, rows in groupby(history, itemgetter(1)):
            held = list(rows)
            ledger = _run(ledger, [_symbol(r) for r in held], held[0][-1])[2]
        out.append((project, ledger.number, sorted(ledger.stems)))
        if len(out) >= 20000:
            yield _batch(out, ARROW_HEAD)
            out = []
    if out:
        yield _batch(out, ARROW_HEAD)


def _arrow(schema: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, types[t]) for name, t in (x.split() for x in schema.split(", "))])


ARROW_ROW, ARROW_HEAD = _arrow(ROW), _arrow(HEAD)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def asked(evidence: DataFrame) -> DataFrame:
    """``evidence`` with all columns that naming reads, and no others."""
    return evidence.select(*(F.col(k).cast(t).alias(k) if k in evidence.columns else F.lit(None).cast(t).alias(k) for k, t in EVIDENCE.items()))


def _histories(evidence: DataFrame, unread: tuple[str, ...] = ()) -> DataFrame:
    """``evidence`` in the order of its histories, a project in one part, for one Python task a part.

    A call and a frame a project cost far more than its rows.  Columns that are missing, or ``unread``, do not travel: a
    list that is null costs Arrow's writer far more than all words of its row.
    """
    order = ("project_id", "seq", "start", "key")
    rows = asked(evidence).select(*(k for k in EVIDENCE if k in order or (k in evidence.columns and k not in unread)))
    dealt = rows.repartition(parts(rows), "project_id").sortWithinPartitions(*(F.asc_nulls_last(c) for c in order))
    return dealt.drop(*unread)


def frame(rows: list[tuple]) -> pd.DataFrame:
    """Of ROW; a sibling has no start."""
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in ROW.split(", ")])
    return out.assign(start=out["start"].astype("Int32"))


def name_symbols(evidence: DataFrame, ledger: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
    """Placeholders for all symbols of all projects, as ROW; a group is a project's history.

    ``reserved`` are the words that survive in an invocation's text, of which its first row counts.  Rows that have no
    start are what the ledger gains besides: fields that accessors name first, and accessors that were not seen.
    With ``ledger`` (project_id, key, placeholder, original) and ``heads`` (project_id, next_number, stems) naming goes on
    from there: a key that the ledger holds keeps its word, whatever survives in the text.
    """
    if ledger is None or heads is None:
        return _histories(evidence).mapInArrow(_name_sorted, ROW)
    rows = asked(evidence)
    held = heads.select("project_id", "next_number", "stems").join(ledger.select("project_id", "key", "placeholder", "original"), "project_id", "left")

    def run(part: pd.DataFrame, had: pd.DataFrame) -> pd.DataFrame:
        start = Growing()
        if len(had):
            names = {k: (w, o) for k, w, o in zip(had["key"], had["placeholder"], had["original"], strict=True) if k is not None}
            start = Growing(int(had["next_number"].iloc[0]), names, set(had["stems"].iloc[0] if had["stems"].iloc[0] is not None else ()))
        return frame(name_runs(part, start)[0] if len(part) else [])

    return rows.groupBy("project_id").cogroup(held.groupBy("project_id")).applyInPandas(run, ROW)


def ledger_delta(named: DataFrame) -> DataFrame:
    """What naming adds to the ledger: (project_id, key, placeholder, original)."""
    return named.where("fresh").groupBy("project_id", "key").agg(F.min_by(F.struct("placeholder", "original"), F.struct("seq", "placeholder")).alias("r")).select("project_id", "key", "r.*")


def delta_heads(named: DataFrame) -> DataFrame:
    """The counter and the stems after the last invocation: (project_id, next_number, stems)."""
    return named.groupBy("project_id").agg(F.max("next_number").alias("next_number"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("stems")))).alias("stems"))


def history_heads(evidence: DataFrame) -> DataFrame:
    """``delta_heads`` of ``name_symbols``, from a fold that writes no row for a name."""
    return _histories(evidence, ("start", "original", "field_name")).mapInArrow(_heads_sorted, HEAD)
