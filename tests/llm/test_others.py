"""Pages, archives and vectors."""

import gzip
import hashlib
import io

import numpy as np
from pyspark.sql import functions as F

from aliasflow.llm import ann, html_extract, warc
from aliasflow.llm.html_pages import labelled_pages

PAGES = [
    (1, "http://a.example/x?y=1", "<p>same payload, long enough to be worth a revisit record, " + "x" * 100),
    (2, None, "<p>same payload, long enough to be worth a revisit record, " + "x" * 100),
    (3, "http://ü.example/ä b\r\nz", "short"),
    (4, "u", "short"),
    (5, "u", None),
    (6, "u", ""),
    (7, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 2000),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    files = warc.write_archives(pages)
    records = warc.read_archives(files)
    assert records.groupBy("type").count().orderBy("type").collect() == [("metadata", 7), ("request", 7), ("response", 6), ("revisit", 1)]
    got = {r.response.page_id: r for r in warc.transactions(records).collect()}
    for page, _, text in PAGES:
        payload = (text or "").encode()
        r = got[page].response
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.type, r.refers_page) == (("revisit", 1) if page == 2 else ("response", None))
        assert page == 2 or bytes(r.payload) == payload
        assert got[page].request.type == "request" and got[page].metadata.type == "metadata"
    assert got[2].response.refers_to == got[1].response.record_id
    assert warc.transactions(warc.read_archives(warc.write_archives(pages.limit(0)))).collect() == []


def test_archives_of_any_number_and_of_repeated_rows(spark, tmp_path):
    long_, other = "p" * 150, "q" * 150
    rows = [(2**62 + 5, "u", long_, 1), (5, "u", other, 1), (-(2**63), "v", other, 2), (2**63 - 1, None, long_, 3), (None, "w", long_, 4), (None, "w", long_, 4), (7, "x", long_, 5), (7, "x", long_, 5), (7, "y", other, 5), (None, None, "r" * 120, 6)]
    spark.createDataFrame(rows, "page_id long, url string, html string, row int").coalesce(2).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    made = [r.response for r in warc.transactions(warc.read_archives(warc.write_archives(pages))).collect()]
    assert len(made) == len(rows) == len({r.record_id for r in made})
    said = sorted(((r.page_id, r.payload_digest, r.type, r.refers_page) for r in made), key=repr)
    d = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(2**62 + 5, d(long_), "revisit", 7), (5, d(other), "revisit", -(2**63)), (-(2**63), d(other), "response", None), (2**63 - 1, d(long_), "revisit", 7), (None, d(long_), "revisit", 7), (None, d(long_), "revisit", 7), (7, d(long_), "response", None), (7, d(long_), "revisit", 7), (7, d(other), "revisit", -(2**63)), (None, d("r" * 120), "response", None)]
    assert said == sorted(want, key=repr)
    responses = {r.record_id for r in made if r.type == "response"}
    assert all(r.refers_to in responses for r in made if r.type == "revisit")


def test_records_are_gzip_members_of_the_standard_form():
    raw = b"".join(gzip.compress(x) for x in warc.capture(9, 0, "http://h.example/p?q", b"body", None))
    found = list(warc.parse(gzip.open(io.BytesIO(raw))))
    assert [h["warc-type"] for _, h, _ in found] == ["response", "request", "metadata"] and found[0][2].endswith(b"\r\n\r\nbody")
    assert found[1][1]["warc-concurrent-to"] == found[0][1]["warc-record-id"] and b"GET /p?q HTTP/1.1\r\nHost: h.example" in found[1][2]
    assert [warc.number(x) for x in ("7", "-3", None, "", "x", str(2**63))] == [7, -3, None, None, None, None]
    assert len({warc.record_id(k, p, r) for k in ("response", "request") for p in (0, 1, None) for r in (0, 1)}) == 12


def test_the_best_run_is_the_best_of_all_intervals():
    rng = np.random.default_rng(8)
    for n in [0, 1, 2, 5, 9, 30] * 20:
        scores = rng.integers(-4, 5, n).astype(float).tolist()
        a, b = html_extract.best_run(scores)
        best = max((sum(scores[i:j]) for i in range(n) for j in range(i + 1, n + 1)), default=0.0)
        assert sum(scores[a:b]) == max(best, 0.0)
        if best > 0:  # the first of equal ones
            assert (a, b)[1] == min(j for i in range(n) for j in range(i + 1, n + 1) if sum(scores[i:j]) == best)


def test_extraction_takes_time_in_proportion():
    import time

    texts = ["<div>" * 20000 + "</p>" * 20000, "<a " * 60000 + '">', '<a href="x' * 40000, "<" * 100_000, "<!--" * 40000, "<script>" * 40000, "<a <b" * 40000 + ">", "<p title='" * 30000]
    for text in texts:
        began = time.perf_counter()
        html_extract.extract(text)
        assert time.perf_counter() - began < 3, text[:20]


def test_extraction_of_labelled_layouts():
    for page in labelled_pages(80, seed=77):
        assert html_extract.extract("".join(x for x, _ in page)) == html_extract.extract("<article>" + "".join(x for x, c in page if c) + "</article>")
    weights = html_extract.weights()
    assert weights["word"] > 0 and all(w < 0 for k, w in weights.items() if k != "word")


def test_extraction_by_hand():
    page = """<!DOCTYPE html><html><head><title>no</title><script>var a = "</p><b>";</script></head><body>
    <nav><a href=/>Home</a></nav><div class="cookie-banner">We set cookies, a lot of them, for you and for us.</div>
    <main><h1>A &amp; B</h1><p>One<b>two</b> three&nbsp;four &lt;x&gt;<p>Five<br>six<!-- no --><div id=comments><p>First!</p></div></main>
    <form><label>Name</label></form><footer>&copy; x</footer>"""
    assert html_extract.extract(page) == "A & B Onetwo three four <x> Five six"
    assert html_extract.extract("") == html_extract.extract("<div><br></div>") == ""
    assert html_extract.extract("just text > here") == "just text > here"
    assert html_extract.extract("<p>" * 3000 + "deep") == "deep"


def test_extraction_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, "u", None, "r"), (2, None, "<p>x y</p>", "s"), (2, None, "<p>x y</p>", "s")], "page_id long, url string, html string, row string")
    out = html_extract.extract_main_text(pages)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "u", "r", ""), (2, None, "s", "x y"), (2, None, "s", "x y")]
    assert html_extract.extract_main_text(pages.limit(0)).collect() == []


def exact(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        out[int(ids[q])] = [int(ids[i]) for i in np.lexsort((ids, d)) if i != q][:k]
    return out


def test_neighbours_reach_the_recall_and_are_exact_in_score(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1500, 12)) + 3 * rng.normal(size=(1, 12)), np.tile(rng.normal(size=(1, 12)), (700, 1))])
    ids = np.arange(len(x)) * 3
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    bad = [(7, None), (8, [0.0] * 12), (9, [1.0] * 11 + [None]), (10, [float("nan")] * 12), (11, [1.0] * 5), (None, [1.0] * 12), (ids[5].item(), x[5].tolist())]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = ann.nearest(frame, F.col("vec_id") % 100 == 0, cells=16, probes=10, parts=6, keep=100, sample=1000).collect()
    want = exact(ids, x, [i for i in range(len(ids)) if ids[i] % 100 == 0])
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - np.sqrt(((x[r.query_id // 3] - x[r.vec_id // 3]) ** 2).sum())) < 1e-9
    assert found.keys() == want.keys() and all(len(v) == 10 for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.95 * 10 * len(want)
    hot = [q for q in want if q >= 4500]
    assert hot and all(found[q] == want[q] for q in hot)  # of equal vectors the smallest ids


def test_neighbours_of_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.nearest(few, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 2**0.5)]
    wide = few.selectExpr("vec_id", "embedding", "1 AS id", "'x' AS query_id", "2 AS cell", "'r' AS rank")
    assert sorted(map(tuple, ann.nearest(wide, F.col("vec_id") % 100 == 0).collect())) == got
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ann.nearest(twice, F.col("vec_id") % 100 == 0).collect())) == [(0, 1, 1, 0.0)]
    assert ann.nearest(few.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16)) * 8
    x = (centres[rng.integers(0, 60, 20_000)] + rng.normal(size=(20_000, 16))).astype(np.float32)
    coarse = ann.kmeans(x[:8000], 100, 10, rng)
    assert ann.probes_to_reach(x[:8000], coarse, 0.98) <= 20
    flat = rng.normal(size=(4000, 16)).astype(np.float32)
    assert ann.probes_to_reach(flat, ann.kmeans(flat, 60, 10, rng), 0.98) > 10
    ids = np.arange(len(x))
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(frame, F.col("vec_id") % 500 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(ids, x.astype(float), list(range(0, len(x), 500)))
    assert found.keys() == want.keys() and sum(len(found[q] & set(want[q])) for q in want) >= 0.9 * 10 * len(want)


def test_cells_and_visits_in_runs(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 20)
    monkeypatch.setattr(ann, "VISITS", 3)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(frame, F.col("vec_id") % 10 == 0, cells=5, probes=5).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(np.arange(400), x, list(range(0, 400, 10)))
    assert sum(len(found[q] & set(want[q])) for q in want) >= 0.97 * 10 * len(want)
