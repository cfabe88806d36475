"""Substring deduplication of different texts under one doc_id, or without one, against the words themselves."""

import pytest
from pyspark.sql import functions as F

from aliasflow.llm import substring_dedup
from aliasflow.llm.common import NO_ID

RUN = " ".join(f"w{i}" for i in range(25))
FILL = " ".join(f"f{i}" for i in range(40))
DOCS = [
    (None, f"a1 a2 a3 {RUN} " + FILL.replace("f", "g")),
    (None, f"b1 b2 b3 {RUN} " + FILL.replace("f", "h")),  # the same windows at the same start
    (None, " ".join(f"c{i}" for i in range(10)) + f" {RUN} c"),
    (None, FILL.replace("f", "p") + " " + FILL.replace("f", "q")),  # nothing of it is repeated
    (None, FILL.replace("f", "r")),
    (None, FILL.replace("f", "r")),  # the same row again
    (None, None),
    (5, f"d1 d2 d3 {RUN} d"),
    (5, f"e1 e2 e3 {RUN} e"),
    (5, FILL.replace("f", "s") + " " + FILL.replace("f", "t")),
    (6, FILL.replace("f", "u")),
    (7, FILL.replace("f", "u") + " end"),
]


def brute_force(docs, size=20):
    """Documents are (id, hash of the text); docs has rows of id, hash and text."""
    split = {(NO_ID if x is None else x, h): (t or "").split() for x, h, t in docs}
    seen = {}
    for k in sorted(split):
        for i in range(len(split[k]) - size + 1):
            seen.setdefault(tuple(split[k][i : i + size]), (k, i))
    out = []
    for x, h, _ in docs:
        k = (NO_ID if x is None else x, h)
        own = split[k]
        gone = {j for i in range(len(own) - size + 1) if seen[tuple(own[i : i + size])] != (k, i) for j in range(i, i + size)}
        out.append((x, len(own), len(gone), " ".join(w for j, w in enumerate(own) if j not in gone)))
    return out


@pytest.mark.parametrize("held", [1_500_000, 30])
def test_different_texts_with_null_and_equal_ids(spark, monkeypatch, held):
    monkeypatch.setattr(substring_dedup, "HELD", held)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    hashed = [tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_force(hashed), key=repr)
    assert sum(n for *_, n, _ in got) == 25 * 4 + 40  # all copies of RUN but one, and one of the last two texts
