"""Strict readers of JSON, YAML and XML that keep the offsets of every label and value.

Nodes are tuples: ("map", [(label, (start, end), node), …]), ("list", [node, …]), ("leaf", (start, end)).  A reader
returns None for text it does not take whole.  Escapes are not decoded: spans are what the text says.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Node = tuple
JSON = re.compile(r'\s*(?:(?P<sign>[{}\[\]:,])|"(?P<string>(?:[^"\\]|\\.)*)"|(?P<bare>(?:[^\W_]|[+\-.])+))', re.S)
YAML = re.compile(r'^(?P<indent> *)(?P<dash>- )?(?P<label>[^:]+):(?: *(?P<value>\S.*?))?[ ]*$', re.S)
XML = re.compile(r"<(?P<close>/?)(?P<tag>[A-Za-z_][\w.-]*)(?P<attributes>(?:\s+[\w.:-]+=\"[^\"<]*\")*)\s*(?P<empty>/?)>")


def read_json(text: str, root: str = "list") -> Node | None:
    """A stack of open containers; what may come next follows from the one on top."""
    stack: list[list] = []  # [kind, items, label or None, what is expected]
    done, at = None, 0

    def put(node: Node) -> bool:
        nonlocal done
        if not stack:
            done = node
            return True
        top = stack[-1]
        if top[3] != "value":
            return False
        top[1].append((text[slice(*top[2])], top[2], node) if top[0] == "map" else node)
        top[3] = "next"
        return True

    size = len(text.rstrip())
    while at < size:
        m = JSON.match(text, at)
        if not m or done is not None:
            return None
        at, kind = m.end(), m.lastgroup
        top = stack[-1] if stack else None
        if kind == "sign" and m["sign"] in "{[":
            if top and top[3] not in ("value", "first"):
                return None
            if top and top[3] == "first":
                if top[0] == "map":
                    return None
                top[3] = "value"
            stack.append(["map" if m["sign"] == "{" else "list", [], None, "first"])
        elif kind == "sign" and m["sign"] in "}]":
            if not top or top[0] != ("map" if m["sign"] == "}" else "list") or top[3] not in ("first", "next"):
                return None
            stack.pop()
            if not put((top[0], top[1])):
                return None
        elif kind == "sign" and m["sign"] == ",":
            if not top or top[3] != "next":
                return None
            top[3] = "key" if top[0] == "map" else "value"
        elif kind == "sign":
            if not top or top[3] != "colon":
                return None
            top[3] = "value"
        elif top and top[0] == "map" and top[3] in ("first", "key"):
            if kind != "string":
                return None
            top[2], top[3] = m.span("string"), "colon"
        else:
            if top and top[3] == "first":
                top[3] = "value"
            if not put(("leaf", m.span(kind))):
                return None
    return done if done is not None and done[0] == root and not stack else None


def read_yaml(text: str) -> Node | None:
    """Block mappings and sequences of mappings, told apart by indents."""
    rows, at = [], 0
    for raw in text.split("\n"):
        line = raw.removesuffix("\r")
        if line.strip():
            m = YAML.match(line)
            if not m or m["value"] and m["value"][0] == '"' and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', line[m.start("value") :], re.S):
                return None
            quoted = bool(m["value"]) and m["value"][0] == '"'
            value = (at + m.start("value") + quoted, at + len(line) - quoted) if m["value"] else None
            deep = len(m["indent"]) + 2 * bool(m["dash"])
            rows.append((deep, bool(m["dash"]), m["label"], (at + m.start("label"), at + m.end("label")), value))
        at += len(raw) + 1
    if not rows or rows[0][:2] != (2, True):
        return None
    root: Node = ("list", [])
    open_: list[tuple[int, Node, list | None]] = []  # (indent of its entries, mapping, the list it is an item of)
    pending: list | None = root[1]  # where a deeper block goes
    base = 0
    for deep, dash, label, span, value in rows:
        if dash:
            while open_ and open_[-1][0] > deep:
                open_.pop()
            if open_ and open_[-1][0] == deep and open_[-1][2] is not None:
                items = open_.pop()[2]
            elif pending is not None and deep - 2 >= base:
                items = pending
            else:
                return None
            node: Node = ("map", [])
            items.append(node)
            open_.append((deep, node, items))
        elif not open_ or deep > open_[-1][0]:
            if pending is None or not open_:
                return None
            node = ("map", [])
            open_[-1][1][1][-1] = (*open_[-1][1][1][-1][:2], node)
            open_.append((deep, node, None))
        else:
            while open_ and open_[-1][0] > deep:
                open_.pop()
            if not open_ or open_[-1][0] != deep:
                return None
        pending = None
        if value is None:
            block: Node = ("list", [])
            pending, base = block[1], deep + 1
            open_[-1][1][1].append((label, span, block))
        else:
            open_[-1][1][1].append((label, span, ("leaf", value)))
    return root


def read_xml(text: str) -> tuple[str, Node] | None:
    """(root tag, node).  Elements with elements are mappings, or lists where all are Item; others are values."""
    stack: list[tuple[str, list, int]] = []
    at = len(text) - len(text.lstrip())
    while at < len(text):
        m = XML.match(text, at)
        if not m:
            return None
        at = m.end()
        if m["close"]:
            tag, entries, begin = stack.pop() if stack else (None, [], 0)
            if tag != m["tag"]:
                return None
            inner = text[begin : m.start()]
            node: Node = ("leaf", (begin, m.start())) if not entries else ("list", [n for *_, n in entries]) if all(x == "Item" for x, *_ in entries) else ("map", entries)
            if entries and re.sub(r"<[^>]*>[^<]*</[^>]*>|<[^>]*>", "", inner).strip():
                return None
        else:
            if m["attributes"].strip() and (stack or not re.fullmatch(r'\s+xmlns="[^"]*"', m["attributes"])):
                return None
            tag, node = m["tag"], ("map", [])
            if not m["empty"]:
                stack.append((tag, [], at))
                at = _skip_text(text, at)
                if at < 0:
                    return None
                continue
        if not stack:
            return (tag, node) if not text[at:].strip() else None
        stack[-1][1].append((tag, m.span("tag"), node))
        if (at := _skip_text(text, at)) < 0:
            return None
    return None


MARKUP = re.compile(r'<(?P<close>/)?(?P<tag>[\w.-]+)(?P<attributes>(?:\s*[\w.:-]+\s*=\s*"[^"]*")*)\s*(?P<empty>/)?>')
PAIR = re.compile(r'([\w.:-]+)\s*=\s*"([^"]*)"')
CDATA = re.compile(r"(?:<!\[CDATA\[.*?\]\]>)+(?=</)", re.S)


def read_attributed(text: str, root: str, data: bool = False) -> Node | None:
    """The mapping of an element of the name ``root`` that is the whole text: its attributes, then its elements.

    With ``data``, an element may hold character data or CDATA sections beside attributes; these are its entry #text.
    Values carry as a third part where they lie with their label.
    """
    open_: list[tuple[str, list, int, int]] = []  # tag, entries, where it begins, where its content does
    at = len(text) - len(text.lstrip())
    while at < len(text):
        m = MARKUP.match(text, at)
        if not m:
            return None
        begin, at = at, m.end()
        if not m["close"]:
            own = [(a[1], (m.start("attributes") + a.start(1),), ("leaf", _within(m, a, 2), _within(m, a, 0))) for a in PAIR.finditer(m["attributes"])]
            if not m["empty"]:
                open_.append((m["tag"], own, begin, at))
                held = _content(text, at, data)
                if held is not None:
                    inner, end = held
                    if own and data:
                        own.append(("#text", (), ("leaf", inner, (at, end))))
                    elif own or not data and text[slice(*inner)].strip() == "":
                        return None
                    at = end
                elif (at := _blank(text, at)) < 0:
                    return None
                continue
            node: Node = ("map", own) if own else ("leaf", (at, at), (begin, at))
            tag = m["tag"]
        else:
            if not open_ or open_[-1][0] != m["tag"] or m["attributes"]:
                return None
            tag, entries, low, inside = open_.pop()
            children = [n for _, _, n in entries]
            if entries and all(x == "Item" for x, *_ in entries):
                node = ("list", children)
            elif entries:
                node = ("map", entries)
            else:
                found = _content(text, inside, data)
                node = ("leaf", found[0] if found else (inside, begin), (low, at))
        if not open_:
            return node if tag == root and node[0] == "map" and not text[at:].strip() else None
        open_[-1][1].append((tag, (), node))
        if (at := _blank(text, at)) < 0:
            return None
    return None


def _within(m: re.Match, a: re.Match, group: int) -> tuple[int, int]:
    return m.start("attributes") + a.start(group), m.start("attributes") + a.end(group)


def _content(text: str, at: int, data: bool) -> tuple[tuple[int, int], int] | None:
    """Character data from here to an end tag, without the marks of CDATA, and where the end tag begins; None if there are elements or nothing."""
    end = text.find("<", at)
    if data and (m := CDATA.match(text, at)):
        return (at + len("<![CDATA["), m.end() - len("]]>")), m.end()
    if end < 0 or not text.startswith("</", end) or not data and not text[at:end].strip():
        return None
    return (at, end), end


def _blank(text: str, at: int) -> int:
    """Where the next tag begins, if only blanks lie before it; else -1."""
    end = text.find("<", at)
    return end if end >= 0 and not text[at:end].strip() else -1


def _skip_text(text: str, at: int) -> int:
    """Where the next tag begins; -1 if none does, or a reference is not closed."""
    end = text.find("<", at)
    return end if end >= 0 and ">" not in text[at:end] else -1


READERS: dict[str, Callable[[str], Node | None]] = {
    "json": read_json,
    "yaml": read_yaml,
    "xml": lambda text: (lambda r: r[1] if r and r[0] == "explain" else None)(read_xml(text)),
}
