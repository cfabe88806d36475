"""PostgreSQL text plans: every line must be a node, a known field or a subplan header, or the whole text is refused."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..operators.formats import NODE_LABELS
from .expressions import READERS, SHAPES, Span, chain, masked, named, tokens, trimmed
from .vocabulary import BY_LABEL, RAW_NAME_ROWS

LINE = re.compile(r"^(?P<lead>\s*(?:->\s*)?(?:Parallel )?)(?P<body>.*?)\r?$", re.S)
NODE = re.compile("(" + "|".join(sorted(map(re.escape, NODE_LABELS), key=len, reverse=True)) + r")(?![^\W\d_])")
FIELD = re.compile(r"((?:[^\W_]|[ \-/])+):(?!:)")
CTE, SUBPLAN = re.compile(r"CTE (\S+)"), re.compile(r"(SubPlan|InitPlan) \d+( \(returns [$\d, ]+\))?")


class Refused(Exception):
    """The text is not read; ``form`` names why, or is None where there is nothing to say."""

    def __init__(self, form: str | None = None) -> None:
        self.form = form


def field_kind(label: str) -> str | None:
    """What becomes of a field; a numbered label counts as its bare one."""
    return BY_LABEL.get(label) or (BY_LABEL.get(label.rpartition(" ")[0]) if re.fullmatch(r"[+-]?\d+", label.rpartition(" ")[2]) else None)


def _lines(text: str) -> Iterator[tuple[str, int, int, str, re.Match | None]]:
    """(kind, start of body, end, label, match) of each line that is not blank."""
    at = 0
    for raw in text.split("\n"):
        m = LINE.match(raw)
        low, high = at + m.start("body"), at + m.end("body")
        body = m["body"]
        at += len(raw) + 1
        if not raw.strip():
            continue
        if body.startswith(RAW_NAME_ROWS):
            raise Refused("POSTGRES_TEXT_RAW_NAME_ROW")
        if f := FIELD.match(body):
            kind = field_kind(f[1])
            if kind is None:
                raise Refused
            yield kind, low + f.end(), high, f[1], None
        elif n := NODE.match(body):
            yield "node", low, high, n[1], n
        elif CTE.fullmatch(body.strip()) or SUBPLAN.fullmatch(body.strip()):
            yield "declared", low, high, "", None
        else:
            raise Refused


def _declaration(text: str, low: int, high: int, declared: set[str]) -> Iterator[Span]:
    low, high = trimmed(text, low, high)
    own = text[low:high]
    if SUBPLAN.fullmatch(own):
        yield Span(low, high, low, high, "preserve")
        return
    if m := CTE.fullmatch(own):
        yield Span(low, low + m.start(1), low, low + m.start(1), "preserve")
        low, own = low + m.start(1), m[1]
    if own:
        declared.add(own)
        yield Span(low, high, low, high, "anonymize", "TABLE", f"plan-declared:TABLE:{own}")


def _node(text: str, low: int, high: int, label: str, declared: set[str]) -> Iterator[Span]:
    """The index after ``using``, the relation after ``on``, and an alias after it."""
    head = text[low:high].partition("  (")[0]
    all_ = tokens(text, low, low + len(head)) or []

    def qualified(begin: int, role: str) -> tuple[list[Span], int]:
        at = next((i for i, t in enumerate(all_) if t.start >= begin), None)
        if at is None or not all_[at].is_name:
            return [], begin
        parts = chain(all_, at)
        return [named(t, role if t is parts[-1] else "SCHEMA", declared) for t in parts], parts[-1].end

    at = low + len(label)
    if (using := head.find(" using ", len(label))) >= 0:
        spans, at = qualified(low + using + 7, "INDEX")
        yield from spans
    if label.endswith(" on"):
        relation = low + len(label)
    elif (on := head.find(" on ", at - low)) >= 0:
        relation = low + on + 4
    else:
        return
    spans, end = qualified(relation, "INDEX" if label == "Bitmap Index Scan" else "TABLE")
    yield from spans
    alias = next((t for t in all_ if t.start >= end), None)
    if alias is not None and alias.is_name:
        declared.add(alias.text)
        yield Span(alias.start, alias.end, *alias.name, "anonymize", "TABLE", f"plan-declared:TABLE:{alias.text}")


def parse(text: str) -> list[Span]:
    """Spans in document order; raises Refused."""
    lines = list(_lines(text))

    def read(declared: set[str]) -> Iterator[Span]:
        for kind, low, high, label, _ in lines:
            if kind == "node":
                yield from _node(text, low, high, label, declared)
            elif kind == "declared":
                yield from _declaration(text, low, high, declared)

    declared: set[str] = set()
    for _ in read(declared):  # a use may come before its declaration
        pass
    out = list(read(declared))
    for kind, low, high, *_ in lines:
        if kind in SHAPES:
            a, b = trimmed(text, low, high)
            out += [Span(a, b, a, b, "preserve")] if SHAPES[kind].fullmatch(text[a:b]) else masked(text, a, b)
        elif kind in READERS:
            out += READERS[kind](text, low, high, declared)
    return sorted(out)
