"""Oracle's plan grid, its predicates, and its outline, whose hints are read name by name."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..operators.formats import GRID
from .expressions import ORACLE, Span, Token, chain, expression, literal, masked, named, tokens, trimmed
from .fields_oracle import HINT_WORDS, HINTS, QUERY_BLOCK, VERSION_HINTS
from .postgres_text import Refused
from .structured import SHAPES

OPERATION = re.compile(SHAPES["operation"])
#: A hint's arguments, a letter a token: numbers, signs, literals and words by themselves, a query block after @, and
#: names joined by dots with a query block after them or not.
ARGUMENTS = re.compile(r"(?:n|m|l|w|@d|d(?:\.d)*(?:@d)?)*")
RULE, HASH, ENTRY = re.compile(r"-{3,}"), re.compile(r"Plan hash value: (\d+)"), re.compile(r"\s*\d+ - ")
TITLES = {"Predicate Information (identified by operation id):": "predicates", "Outline Data": "outline"}


def _cells(line: str, at: int) -> list[tuple[int, int]]:
    bars = [m.start() for m in re.finditer(r"\|", line)]
    return [(at + a + 1, at + b) for a, b in zip(bars, bars[1:], strict=False)]


def _row(text: str, cells: list[tuple[int, int]], header: list[str]) -> Iterator[Span]:
    said = [text[slice(*trimmed(text, *c))] for c in cells]
    if len(said) != len(header) or said == header:
        raise Refused
    operation = said[header.index("Operation")] if "Operation" in header else ""
    for column, cell, own in zip(header, cells, said, strict=True):
        a, b = trimmed(text, *cell)
        if column == "Name" and own:
            role = "INDEX" if operation.startswith(("INDEX", "BITMAP INDEX")) else "TABLE"
            yield Span(a, b, a, b, "anonymize", role, f"plan:{role}:{own}")
        elif column == "Operation" and own:
            yield from [Span(a, b, a, b, "preserve")] if OPERATION.fullmatch(own) else masked(text, a, b)


def _letter(token: Token) -> str:
    if token.kind == "mark":
        return token.text if token.text in "@." else "m" if token.text in "(),=" else "?"
    return {"number": "n", "literal": "l", "delimited": "d"}.get(token.kind, "w" if token.text in HINT_WORDS else "?")


def _block(text: str, token: Token) -> Iterator[Span]:
    """A query block keeps a name that the engine made."""
    a, b = token.name
    yield Span(token.start, token.end, token.start, token.end, "preserve") if re.fullmatch(QUERY_BLOCK, text[a:b]) else Span(token.start, token.end, a, b, "mask", None, f"plan-mask:{text[a:b]}")


def hint(text: str, low: int, high: int) -> Iterator[Span]:
    """One hint of an outline: known words stay, names and values go; a hint of another shape is masked whole."""
    all_ = tokens(text, low, high) or []
    inner = all_[2:-1]
    shaped = len(all_) == 1 or len(all_) > 2 and all_[1].text == "(" and all_[-1].text == ")"
    if not all_ or all_[0].kind != "word" or all_[0].text not in HINTS or not shaped or not ARGUMENTS.fullmatch("".join(map(_letter, inner))):
        yield from masked(text, low, high, True)
        return
    if inner and all_[0].text in VERSION_HINTS:
        only = inner[0]
        if len(inner) > 1 or only.kind != "literal" or not re.fullmatch(SHAPES["version"], only.text[1:-1]):
            yield from masked(text, low, high, True)
            return
        inner = [only._replace(kind="word")]
    yield Span(all_[0].start, all_[0].end, all_[0].start, all_[0].end, "preserve")
    at = 0
    while at < len(inner):
        token = inner[at]
        if token.text == "@" and token.kind == "mark":
            at += 1
            yield from _block(text, inner[at])
        elif token.kind == "delimited":
            parts = chain(inner, at)
            roles = ["TABLE"] if len(parts) == 1 else ["SCHEMA"] * (len(parts) - 2) + ["TABLE", "COLUMN"]
            yield from (named(t, r, set()) for t, r in zip(parts, roles, strict=True))
            at += 2 * len(parts) - 2
        elif token.kind == "literal":
            yield literal(token)
        elif token.kind == "word":
            yield Span(token.start, token.end, token.start, token.end, "preserve")
        at += 1


def parse(text: str) -> list[Span]:
    """Head, grid, predicates and outline in this order of sections; a line that none of them takes refuses."""
    out: list[Span] = []
    header, section, opened, at = None, "head", False, 0
    for raw in text.split("\n"):
        line, body, low = raw.removesuffix("\r"), raw.strip(), at
        high, at = at + len(line), at + len(raw) + 1
        if not body:
            continue
        if body.startswith("Peeked Binds"):
            raise Refused
        if body in TITLES:
            section = TITLES[body]
        elif RULE.fullmatch(body):
            continue
        elif section in ("head", "grid"):
            if body[0] == "|" and body[-1] == "|" and len(body) > 1:
                cells = _cells(line, low)
                if header is None:
                    header = [text[slice(*trimmed(text, *c))] for c in cells]
                    if not header or not set(header) <= set(GRID):
                        raise Refused
                else:
                    out += _row(text, cells, header)
                section = "grid"
            elif section == "head" and (m := HASH.fullmatch(body)):
                begin = low + line.index(m[1], 17)
                out += masked(text, begin, begin + len(m[1]))
            else:
                raise Refused
        elif section == "predicates":
            m = ENTRY.match(line)
            if not m and not line[0].isspace():
                raise Refused
            out += expression(text, low + (m.end() if m else 0), high, set(), ORACLE)
        elif body == "/*+" and section == "outline":
            opened = True
        elif body == "*/" and section == "outline":
            section = "closed"
        elif section == "outline" and opened:
            out += hint(text, low, high)
        else:
            raise Refused
    if header is None:
        raise Refused
    return sorted(out)
