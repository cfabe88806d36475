"""Every stage of the pipeline on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from aliasflow.llm.common import stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = " ".join(f"k{i}" for i in range(14))
BAD = "vilea vileb grimc murkd"


def prose(seed, n=60):
    return " ".join(f"n{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))


def rows():
    out = [(i, prose(i) + (f" {BAD}" if i % 4 == 0 else ""), "en", f"s{i % 3}" if i % 5 else None, 1) for i in range(120)]
    out += [(None, prose(500 + i), "en", "hot", 1) for i in range(30)]  # different texts without an id
    out += [(None, None, None, None, None), (None, "", "en", None, 0), (900, None, "en", "hot", None)]
    out += [(901, prose(700), "en", "hot", 1), (901, prose(701), "en", "hot", 1), (901, prose(701), "en", "hot", 1)]  # an id twice, a row twice
    out += [(None, f"{prose(801)} {ITEM}", "en", "hot", 1), (902, f"{ITEM} {prose(802)}", "en", None, 1)]  # benchmark passages
    out += [(903, " ".join(f"w{i}" for i in range(30_000)) + " a@b.example.com", "en", "hot", 1)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(rows(), COLUMNS).repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


def run(spark, docs, path):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, path))
        out[name] = [tuple(r) for r in docs.collect()]
    return out, docs


def test_each_stage_keeps_what_it_should(spark, folder):
    out, docs = run(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    given = rows()
    toxic = [r for r in given if r[1] and BAD in r[1]]
    assert sorted(out["toxicity"], key=repr) == sorted((r for r in given if r not in toxic), key=repr)
    distinct = {(r[0], r[1]) for r in out["toxicity"]}
    assert sorted(((r[0], r[1]) for r in out["near_dedup"]), key=repr) == sorted(distinct, key=repr)
    assert {(r[0], r[1]) for r in out["decontamination"]} == {x for x in distinct if not x[1] or ITEM not in x[1]}
    masked = {r[0]: r[1] for r in out["pii"]}
    assert masked[903].endswith("<EMAIL>") and len(out["pii"]) == len(out["decontamination"])
    assert {(r[0], r[1]) for r in out["mixing"]} <= {(r[0], r[1]) for r in out["pii"]} and 0.5 * len(out["pii"]) < len(out["mixing"]) < 1.6 * len(out["pii"])
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies", "copy", "mix_key"]


def test_clashing_columns(spark, folder):
    names = ["key", "same", "row", "spans", "t", "grade", "proposed", "k", "hs", "u", "least", "severity", "id"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({x: F.lit(x) for x in names})
    plain, _ = run(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    wide, last = run(spark, docs, folder)
    for name, _ in corpus_pipeline.STAGES:
        assert sorted((r[:2] for r in wide[name]), key=repr) == sorted((r[:2] for r in plain[name]), key=repr), name
    assert set(names) <= set(last.columns)


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out, _ = run(spark, docs.limit(0), folder)
    assert not any(out.values())
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out, _ = run(spark, docs, str(tmp_path))
    assert len(out["toxicity"]) == docs.count() and len(out["decontamination"]) == len(out["near_dedup"])
