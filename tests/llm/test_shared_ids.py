"""Different texts under one doc_id, or without one, are documents of their own to near-deduplication and the pipeline."""

import corpus_pipeline
from aliasflow.llm import near_dedup

SCHEMA = "doc_id long, text string"
LONG = " ".join(f"v{i}" for i in range(120))
OTHER = " ".join(f"u{i}" for i in range(120))
DOCS = [
    (None, LONG),
    (None, LONG + " tail"),  # a near copy of the first
    (None, OTHER),
    (None, OTHER),  # the same row again
    (None, "clean words that stand alone here"),
    (None, None),
    (None, " "),
    (7, OTHER + " more"),  # has an id, so it stays of its component
    (8, "one text under eight"),
    (8, "quite another text under eight"),
    (9, "one text under eight"),
]


def test_near_duplicates_of_different_texts_with_null_and_equal_ids(spark):
    rows = near_dedup.near_duplicates(spark.createDataFrame(DOCS, SCHEMA).repartition(3)).collect()
    none = near_dedup.NO_ID
    assert len(rows) == len(DOCS)
    assert sorted((r.key, r.n_shingles, r.component_id) for r in rows) == sorted([
        (none, 116, none), (none, 117, none), (none, 116, 7), (none, 116, 7), (none, 2, none), (none, 0, none), (none, 0, none),
        (7, 117, 7), (8, 1, 8), (8, 1, 8), (9, 1, 8),
    ])
    assert sorted((r.key, r.n_shingles) for r in rows if not r.stays)[0] == (9, 1) and sum(not r.stays for r in rows) == 4


def test_the_pipeline_keeps_one_text_of_each_component(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    first = [d for d in kept if d[1] and d[1].startswith("v0 ")]
    assert len(first) == 1
    want = [d for d in DOCS if d not in (DOCS[0], DOCS[1], DOCS[2], DOCS[10])]
    assert sorted((d for d in kept if d not in first), key=repr) == sorted(want, key=repr)
    again = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(2), "").collect()]
    assert sorted(again, key=repr) == sorted(kept, key=repr)
