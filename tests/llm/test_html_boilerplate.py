"""Long boilerplate inside an article parts nothing, and a head left open swallows nothing."""

import pytest

from aliasflow.llm.html_extract import extract

LONG = " ".join(f"buy{i}" for i in range(200))
BLOCKS = [f'<div class="advert"><p>{LONG}</p></div>', f"<aside><ul><li><a href='/x'>{LONG}</a></li></ul></aside>", f'<section id="newsletter">{LONG}</section>']
BODY = " ".join(f"body{i}" for i in range(30))


@pytest.mark.parametrize("block", BLOCKS)
def test_long_blocks_after_the_heading_and_before_the_last_paragraph(block):
    page = f"<html><body><nav>{LONG}</nav><article><h1>Great news</h1><p>A lead.</p>{block}<p>{BODY}</p>{block}<p>The end.</p></article><footer>{LONG}</footer></body></html>"
    assert extract(page) == f"Great news A lead. {BODY} The end."


@pytest.mark.parametrize("start", ["<html><head>", " <!doctype html><html><head>", "<head profile='x'>"])
def test_a_head_without_end_or_body(start):
    page = f"{start}<meta charset='utf-8'><title>Not this</title><script>if (a < b) document.write('<p>nor this</p>')</script><h1>Great news</h1><p>{BODY}</p></html>"
    assert extract(page) == f"Great news {BODY}"
    closed = page.replace("<h1>", "<p>of the head</p></head><h1>")
    assert extract(closed) == extract(closed.replace("</head>", "<body>")) == f"Great news {BODY}"
    assert len(extract("<head>" * 50_000 + "text")) == 4
