"""Main-text extraction from web pages: the maximum-scoring subsequence of their words and tags.

A page becomes a sequence of words and tags.  Every kind has a weight, learned from labelled pages: words score
positive, tags negative (each weight is a log-odds of lying in content, held to its sign).  One linear scan finds the
contiguous run of greatest total score.  Of its text, what stands in elements that are boilerplate by their tag, or by
a word of their class, id or role, is left out, as are scripts, styles, comments and forms; such elements, with all that
they hold, weigh nothing, so that long ones do not part an article.

* A null or empty html, and a page without words, give an empty text.  Of equally good runs the first wins.
* Unclosed elements end with the element around them, or with the page; stray end tags are ignored.  A head goes as far
  as its end tag or the body; without either, only what is no text wherever it stands (title, scripts, styles) goes.
* Tags whose quotes never close end at the next ``>``; a tag that never ends is text.
* Rows are read one by one, so repeated rows repeat; other columns, whatever their names, are kept, but for html and one
  that bears the result's name.  Time grows with a page's length, whatever its markup.
* Character references are decoded; white space inside a block, in the sense of Unicode, becomes one space; blocks
  are joined by one space.  Inline tags separate nothing.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .html_pages import labelled_pages

#: A tag with its attributes; possessive, so that nothing is read twice.  BARE is for pages whose quotes do not close.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
BARE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>")
#: Elements whose content is no text, whatever it looks like.
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in "script style noscript template textarea select svg iframe object title".split()}
#: Where the page's head ends, whatever it holds.
HEAD_END = re.compile(r"</head\s*>|(?=<body\b)", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav header footer aside form button menu dialog fieldset input".split())
ARTICLE = frozenset("article main".split())
#: Words of class, id or role that mark boilerplate.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header menu modal nav navbar navigation newsletter notice outbrain overlay pager pagination popup promo promoted promotion related reply replies respond search share sharing sidebar social sponsor sponsored subscribe subscription taboola teaser toolbar widget".split())
#: No content element is taken for boilerplate by its class.
BODY = frozenset("html body article main".split())


def _marked(attributes: str) -> bool:
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id", "role") and any(x in MARKS for x in re.split(r"[^a-z]+", value)):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, name, '/' or '', attributes) of all markup in page order; comments, declarations and elements of raw
    content have no name, and end where their content does.  Each character is read a bounded number of times."""
    at, tag = 0, TAG
    while (low := page.find("<", at)) >= 0:
        after = page[low + 1 : low + 2]
        if page.startswith("<!--", low):
            high = page.find("-->", low + 4)
            at = high + 3 if high >= 0 else len(page)
            yield low, at, "", "", ""
        elif after in ("!", "?"):
            if (high := page.find(">", low)) < 0:
                return
            at = high + 1
            yield low, at, "", "", ""
        elif not (after.isascii() and (after.isalpha() or after == "/" and page[low + 2 : low + 3].isascii() and page[low + 2 : low + 3].isalpha())):
            at = low + 1  # a sign, not a tag
        elif not (m := tag.match(page, low)):
            if tag is BARE:  # no tag ends any more
                return
            tag = BARE
        else:
            at, name = m.end(), m[2].lower()
            if name in RAW and not m[1]:
                if not m[3].endswith("/"):
                    closes = RAW[name].search(page, at)
                    at = closes.end() if closes else len(page)
                name = ""
            yield low, at, name, m[1], m[3]


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text, in boilerplate) for every tag and every run of text; kinds of text are word and link."""
    stack: list[tuple[str, bool]] = []
    opened: Counter = Counter()
    inside = at = 0
    ends = True

    def said(raw: str) -> Iterator[tuple[str, str, bool]]:
        if raw:
            yield "link" if opened["a"] else "word", html.unescape(raw), inside > 0

    for low, high, name, close, attributes in tags(page):
        if low < at:  # inside the head
            at = max(at, high) if not name else at
            continue
        yield from said(page[at:low])
        at = high
        if not name:
            continue
        if name == "head" and not close:
            ends = HEAD_END.search(page, at) if ends else None  # none after this one is none after the next
            at = ends.end() if ends else at
            continue
        bad = False
        if close:
            while opened[name]:  # else a stray end tag
                top, bad = stack.pop()
                opened[top] -= 1
                inside -= bad
                if top == name:
                    break
            kind = "end"
        else:
            if name in ("p", "li") and stack and stack[-1][0] == name:  # neither holds its own kind
                inside -= stack.pop()[1]
                opened[name] -= 1
            bad = name not in BODY and (name in BOILERPLATE or _marked(attributes))
            if name not in VOID and not attributes.rstrip().endswith("/"):
                stack.append((name, bad))
                opened[name] += 1
                inside += bad
            kind = "boiler" if bad else "begin"
        yield (kind if kind == "boiler" else "inline" if name in INLINE or name == "br" else "article" if name in ARTICLE else "item" if name in ("li", "ul", "ol") else "block"), name if name not in INLINE else "", bad or inside > 0
    yield from said(page[at:])


@lru_cache(1)
def weights() -> dict[str, float]:
    """Log-odds of content for each kind of token, counted over the labelled pages and held to its sign."""
    count = {True: Counter(), False: Counter()}
    for page in labelled_pages():
        for piece, content in page:
            for kind, text, inside in tokens(piece):
                if not (inside and kind in ("word", "link")):
                    count[content][kind] += len(text.split()) if kind in ("word", "link") else 1
    out = {}
    for kind in sorted({*count[True], *count[False]}):
        odds = math.log((count[True][kind] + 0.5) / (count[False][kind] + 0.5))
        out[kind] = max(odds, 0.1) if kind == "word" else min(odds, -0.1)
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run of greatest total, the first of equal ones; empty if no total is above 0.  One linear scan."""
    best = score = 0.0
    begin, span = 0, (0, 0)
    for i, x in enumerate(scores):
        score += x
        if score <= 0:
            score, begin = 0.0, i + 1
        elif score > best:
            best, span = score, (begin, i + 1)
    return span


def extract(page: str, weight: dict[str, float] | None = None) -> str:
    weight = weight or weights()
    all_ = list(tokens(page))
    span = best_run([0.0 if inside else weight.get(kind, -0.1) * (len(text.split()) if kind in ("word", "link") else 1) for kind, text, inside in all_])
    blocks = [[]]
    for kind, text, inside in all_[slice(*span)]:
        if kind in ("word", "link"):
            if not inside:
                blocks[-1].append(text)
        elif text:
            blocks.append([])
    return " ".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def _extractor(weight: dict[str, float], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x or "", weight) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names)

    return run


def extract_main_text(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` without its html, with the main text; a column of that name is replaced."""
    rest = [x for x in pages.columns if x not in (column, into)]
    whole = pages.select(F.struct(*(F.col(f"`{x}`") for x in rest)).alias("row"), F.col(column).cast("string").alias("html"))
    out = whole.mapInArrow(_extractor(weights(), ["row", "text"]), T.StructType([whole.schema["row"], T.StructField("text", T.StringType())]))
    return out.select("row.*", F.col("text").alias(into))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
