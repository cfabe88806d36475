"""Labelled pages to learn region weights from: layouts with content and boilerplate, made by rule from a seed.

Each page is a list of (html, is_content) pieces in page order.
"""

from __future__ import annotations

import random
from collections.abc import Iterator


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


def _links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 4))}</a></li>' for i in range(n)) + "</ul>"


def labelled_pages(n: int = 60, seed: int = 5) -> Iterator[list[tuple[str, bool]]]:
    r = random.Random(seed)
    for _ in range(n):
        page: list[tuple[str, bool]] = [(f"<html><head><title>{_words(r, 5)}</title></head><body>", False)]
        for _ in range(r.randint(1, 3)):
            page.append((r.choice([
                f"<nav>{_links(r, r.randint(3, 9))}</nav>",
                f"<header><div>{_words(r, r.randint(1, 6))}</div>{_links(r, 3)}</header>",
                f'<div class="menu">{_links(r, r.randint(3, 9))}</div>',
                f'<div class="ad">{_words(r, r.randint(5, 30))}</div>',
                f'<div class="cookie-notice"><p>{_words(r, r.randint(8, 30))}</p><button>{_words(r, 2)}</button></div>',
                f'<form><label>{_words(r, 2)}</label><input name="q"></form>',
            ]), False))
        wrap = r.choice(["article", "main", "div", "section"])
        page.append((f"<{wrap}>", True))
        page.append((f"<h1>{_words(r, r.randint(3, 9))}</h1>", True))
        for _ in range(r.randint(2, 9)):
            page.append((r.choice([
                f"<p>{_words(r, r.randint(10, 120))}</p>",
                f"<p>{_words(r, 20)} <a href='/x'>{_words(r, 2)}</a> <b>{_words(r, 3)}</b> {_words(r, 30)}</p>",
                f"<h2>{_words(r, 4)}</h2><p>{_words(r, 40)}<br>{_words(r, 12)}",
                f"<blockquote><p>{_words(r, 25)}</p></blockquote>",
                f"<ul><li>{_words(r, 9)}</li><li>{_words(r, 12)}</li></ul>",
            ]), True))
            if r.random() < 0.15:
                page.append((f'<div class="advert">{_words(r, r.randint(4, 20))}</div>', False))
        page.append((f"</{wrap}>", True))
        for _ in range(r.randint(1, 3)):
            page.append((r.choice([
                f'<aside><h3>{_words(r, 2)}</h3>{_links(r, r.randint(3, 8))}</aside>',
                f'<div id="comments"><div><b>{_words(r, 1)}</b><p>{_words(r, r.randint(5, 40))}</p></div></div>',
                f'<div class="sidebar"><p>{_words(r, r.randint(4, 30))}</p></div>',
                f"<footer>{_words(r, r.randint(3, 25))} {_links(r, 3)}</footer>",
                f'<div class="related">{_links(r, 5)}</div>',
            ]), False))
        page.append(("</body></html>", False))
        yield page
