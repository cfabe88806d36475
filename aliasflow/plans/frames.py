"""Frames that clients put around a plan, and offsets through them."""

from __future__ import annotations

import re
from bisect import bisect_right

BANNER, COUNT = re.compile(r"\*{3,} 1\. row \*{3,}"), re.compile(r"\((\d+) rows?\)")
VERTICAL = re.compile(r"(\d+) rows? in set \(.*\)")


def _lines(text: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for raw in text.split("\n"):
        out.append((at, raw.removesuffix("\r")))
        at += len(raw) + 1
    return out


def _psql(lines: list[tuple[int, str]], rule: str, marker: str) -> list[tuple[int, int]] | None:
    """Outer (start, end) of each row of a table with the one column QUERY PLAN."""
    if len(lines) < 4 or lines[0][1].strip() != "QUERY PLAN" or not re.fullmatch(f"{rule}{{10,}}", lines[1][1]):
        return None
    stop = next((i for i, (_, x) in enumerate(lines) if i > 1 and COUNT.fullmatch(x)), None)
    rows = lines[2:stop]
    if not stop or not rows or any(not x.startswith(" ") for _, x in rows) or rows[-1][1].endswith(marker) or any(x.strip() for _, x in lines[stop + 1 :]):
        return None
    wrapped = len(rows) > 1 and all(x.endswith(marker) for _, x in rows[:-1])
    if int(COUNT.fullmatch(lines[stop][1])[1]) != (1 if wrapped else len(rows)):
        return None
    return [(at + 1, at + max(1, len(x.removesuffix(marker).rstrip(" ")))) for at, x in rows]


def _vertical(lines: list[tuple[int, str]]) -> list[tuple[int, int]] | None:
    """Outer (start, end) of each line of the one row of a vertical listing."""
    if len(lines) < 2 or not BANNER.fullmatch(lines[0][1]) or not lines[1][1].startswith("EXPLAIN: "):
        return None
    stop = next((i for i, (_, x) in enumerate(lines) if i > 1 and (VERTICAL.fullmatch(x) or BANNER.fullmatch(x))), len(lines))
    if stop < len(lines) and (BANNER.fullmatch(lines[stop][1]) or VERTICAL.fullmatch(lines[stop][1])[1] != "1" or any(x.strip() for _, x in lines[stop + 1 :])):
        return None
    return [(at + 9 * (i == 0), at + len(x)) for i, (at, x) in enumerate(lines[1:stop])]


class Frame:
    """The plan inside a frame; the text itself where there is none."""

    def __init__(self, text: str) -> None:
        lines = _lines(text)
        rows = _psql(lines, "-", "+") or _psql(lines, "─", "↵") or _vertical(lines) or [(0, len(text))]
        self.rows, self.inner, at = rows, [], 0
        for a, b in rows:
            self.inner.append(at)
            at += b - a + 1
        self.text = "\n".join(text[a:b] for a, b in rows)

    def outer(self, start: int, end: int) -> tuple[int, int] | None:
        """Where a span of the inner text lies in the outer one; None if it runs over a row's end."""
        i = max(0, bisect_right(self.inner, start) - 1)
        a, b = self.rows[i]
        shift = a - self.inner[i]
        return (start + shift, end + shift) if end + shift <= b else None
