"""The pipeline against a version that uses brute force for each stage's decisions."""

import re

import corpus_pipeline
from aliasflow.llm import decontaminate, near_dedup
from aliasflow.llm.common import stored

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(decontaminate.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stage(spark, docs, SF))
        rows = docs.collect()
        kept[name] = {r.doc_id: r for r in rows}
        if name != "mixing":
            assert docs.columns == columns and len(rows) == len(kept[name]) <= len(before)
        if name == "near_dedup":
            assert set(kept[name]) == {x for x, _, _, own in near_dedup.brute_force([(r.doc_id, r.text) for r in before.values()]) if own}
        if name == "decontamination":
            grams = set()
            for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = words(item.text)
                n = min(10, len(w))
                grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
            sizes = {len(g) for g in grams}
            hit = {x for x, r in before.items() for n in sizes for w in [words(r.text)] for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams}
            assert set(kept[name]) == set(before) - hit
        if name == "pii":
            assert set(kept[name]) == set(before) and not any(re.search(r"[\w.]+@[\w-]+\.\w+", r.text) for r in rows)
        if name == "mixing":
            assert 0.6 * len(before) < len(rows) < 1.4 * len(before) and set(docs.columns) > set(columns)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(t for x, t in labels.items() if x in kept["toxicity"]) <= 0.3 * sum(labels.values())
    assert sum(1 for x, t in labels.items() if not t and x in kept["toxicity"]) >= 0.97 * sum(1 for t in labels.values() if not t)
