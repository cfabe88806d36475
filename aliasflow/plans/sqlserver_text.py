"""SQL Server's plan rows as text: names in brackets, values in quotes, everything else the engine's own."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .expressions import Span, trimmed
from .postgres_text import Refused

NAME = r"\[(?:[^\]]|\]\])+\]"
CHAIN = rf"{NAME}(?:\.{NAME})*"
ROW = re.compile(r"[ |]*\|--(.*?)\r?", re.S)
PIECE = re.compile(rf"OBJECT:\((?P<object>{CHAIN})(?P<aliased> AS (?P<alias>{NAME})?)?|(?P<chain>{CHAIN})|(?P<literal>'(?:[^']|'')*')|OBJECT:\(|['\[]")
#: Roles of an object's parts from the left, by their number.
OBJECT = {1: ("TABLE",), 2: ("SCHEMA", "TABLE"), 3: ("SCHEMA", "SCHEMA", "TABLE"), 4: ("SCHEMA", "SCHEMA", "TABLE", "INDEX")}


def _names(text: str, low: int, high: int, roles: tuple[str, ...], declared: set[str], declares: bool = False) -> Iterator[Span]:
    parts = list(re.finditer(NAME, text[low:high]))
    for m, role in zip(parts, roles, strict=True):
        name = m[0][1:-1].replace("]]", "]")
        if declares:
            declared.add(name)
        kind = "plan-declared" if role == "TABLE" and name in declared else "plan"
        yield Span(low + m.start(), low + m.end(), low + m.start() + 1, low + m.end() - 1, "anonymize", role, f"{kind}:{role}:{name}")


def whole_name(text: str, low: int, high: int, role: str, declared: set[str], declares: bool = False) -> Iterator[Span]:
    """One bracketed name and nothing else; nothing where there is nothing."""
    a, b = trimmed(text, low, high)
    if a < b:
        if not re.fullmatch(NAME, text[a:b]):
            raise Refused
        yield from _names(text, a, b, (role,), declared, declares)


def bracketed(text: str, low: int, high: int, declared: set[str]) -> Iterator[Span]:
    """Chains name a column from the right, objects a table from the left; what is left open refuses."""
    for m in PIECE.finditer(text, low, high):
        if m["object"]:
            n = len(re.findall(NAME, m["object"]))
            if n not in OBJECT or m["aliased"] and not m["alias"]:
                raise Refused
            yield from _names(text, *m.span("object"), OBJECT[n], declared)
            if m["alias"]:
                yield from _names(text, *m.span("alias"), ("TABLE",), declared, True)
        elif m["chain"]:
            n = len(re.findall(NAME, m["chain"]))
            yield from _names(text, *m.span("chain"), (("SCHEMA",) * (n - 2) + ("TABLE", "COLUMN"))[-n:], declared)
        elif m["literal"]:
            yield Span(*m.span(), m.start() + 1, m.end() - 1, "mask", None, f"plan-mask:{m[0][1:-1]}")
        else:
            raise Refused


def parse(text: str) -> list[Span]:
    """Spans of all rows; one heading StmtText may come first, and no other line."""
    rows, at, first = [], 0, True
    for raw in text.split("\n"):
        if raw.strip():
            m = ROW.fullmatch(raw)
            if m and m[1].partition("(")[0].strip().startswith("Remote "):
                raise Refused("SQLSERVER_SHOWPLAN_TEXT_REMOTE")
            if m:
                rows.append((at + m.start(1), at + m.end(1)))
            elif not first or raw.strip() != "StmtText":
                raise Refused
            first = False
        at += len(raw) + 1
    if not rows:
        raise Refused
    declared: set[str] = set()
    for _ in range(2):  # a use may come before its declaration
        out = [s for a, b in rows for s in bracketed(text, a, b, declared)]
    return sorted(out)
