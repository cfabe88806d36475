"""Near-duplicate documents: MinHash, banded candidates, sequential Bayesian pruning, exact verification.

1. One scan makes, of each document's distinct five-word shingles, their number, a fingerprint of the set and a
   MinHash signature.  Documents with equal sets form a class, and only its first document goes on.
2. Signatures are cut into bands; classes that agree in a band share a bucket.  At a similarity of 0.75, 32 bands of
   four rows miss a pair with a probability of 5e-6.  In each bucket the first class is paired with every other, so
   a bucket of m classes makes m - 1 pairs, never m * m.
3. A pair's signatures are compared batch by batch; after each, it goes if the posterior probability (uniform prior)
   that its similarity reaches the threshold is below ``miss``.  Survivors are verified on their full sets.
4. Buckets that components of the links found so far still divide are finished exactly: of their classes, prefixes of
   the sets in a common order are joined, and pairs of different components whose positions leave room for enough
   common shingles are verified.  The order puts rare shingles first, by a table of counters that grows with the texts up
   to a fixed size; any order gives the same links, a good one gives fewer pairs.  A frequent shingle's entries are dealt
   out in blocks by its count, so that no block holds more than about twice ``block`` of them.
5. Components follow from alternating star steps.

* A text that is null or has no words has an empty set and is linked with nothing; with fewer words than a shingle,
  the whole sequence is the one shingle.
* Rows that share doc_id and text are one document given more than once; different texts under one doc_id, or without
  one, are documents of their own.  A null doc_id comes after all others.  Of a component the document with the
  smallest doc_id stays, and of those that share it the one with the smallest hash of its text.
* Shingles, sets and texts are compared by 64-bit fingerprints.
* Other columns, whatever their names, are not read.  No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, UPPER, id_key, shares, stored, table, text_hash
from .components import components
from .wordprints import LOWER, Hasher, U, Words, each, mix

BATCH = 16
#: Counters of shingles: one for so many bytes of text, in chunks, up to 16 MB of them.
PER_COUNTER, CHUNK, MOST_COUNTERS = 128, 1 << 14, 1 << 22
#: Entries of one shingle that make a block.
BLOCK = 20_000


def shingles(w: Words, words: Hasher, runs: Hasher, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as fingerprints in ascending order, text by text, and the text of each."""
    f = words.of_words(w.data, w.start, w.end)
    first, text = w.windows(size)
    n = w.counts()
    short = np.flatnonzero((n > 0) & (n < size))
    h = np.concatenate([runs.of_runs(f, first, size), runs.of_runs(f, w.bounds[:-1][short], n[short])])
    text = np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def _sketcher(size: int, rows: int, seed: int):
    times = np.random.default_rng(seed).integers(1, 2**63, rows, dtype=np.uint64) * U(2) + U(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, runs = Hasher(1), Hasher(5)
        for batch in batches:
            for low, high, w in each(batch.column(2), case=LOWER):
                h, text = shingles(w, words, runs, size)
                cut = np.searchsorted(text, np.arange(high - low + 1))
                n = np.diff(cut)
                full = np.flatnonzero(n)
                sig = np.zeros((high - low, rows), np.uint32)
                f1, f2 = np.zeros(high - low, U), np.zeros(high - low, U)
                if len(full):
                    at = cut[:-1][full]
                    for i in range(rows):
                        sig[full, i] = np.minimum.reduceat(h * times[i], at) >> U(32)
                    f1[full], f2[full] = np.add.reduceat(mix(h, 77), at), np.bitwise_xor.reduceat(mix(h, 99), at)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(low, high - low) for i in (0, 1)), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())],
                    ["key", "same", "n", "f1", "f2", "sig"],
                )

    return sketch


def least_matches(rows: int, threshold: float, miss: float, batch: int = BATCH) -> dict[int, int]:
    """After k rows compared: the fewest matches m with P(similarity >= threshold | m of k) >= miss, under a uniform prior."""
    out = {}
    for k in range(batch, rows + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:  # P(Beta(m + 1, k - m + 1) >= t) = P(Binomial(k + 1, t) <= m)
            m += 1
            tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out[k] = m
    return out


def _pruner(rows: int, threshold: float, miss: float):
    least = least_matches(rows, threshold, miss)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, rows) for i in (2, 3))
            on, same = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k, m in least.items():
                same = same + (x[on, k - BATCH : k] == y[on, k - BATCH : k]).sum(1)
                on, same = on[same >= m], same[same >= m]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(on)) for i in (0, 1)], ["a", "b"])

    return prune


def _sets(keys: np.ndarray, texts: list[str], size: int, words: Hasher, runs: Hasher) -> dict[int, np.ndarray]:
    out, (_, at) = {}, np.unique(keys, return_index=True)
    for low, high, w in each(pa.array([texts[i] for i in at], pa.string()), case=LOWER):
        h, text = shingles(w, words, runs, size)
        cut = np.searchsorted(text, np.arange(high - low + 1))
        out.update((int(keys[at[low + i]]), h[cut[i] : cut[i + 1]]) for i in range(high - low))
    return out


def _verifier(size: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, runs = Hasher(1), Hasher(5)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                a, b = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
                sets = _sets(np.concatenate([a, b]), batch.column(2).to_pylist() + batch.column(3).to_pylist(), size, words, runs)
                good = []
                for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    good.append(100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return verify


def _counter(size: int, counters: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, runs, total = Hasher(1), Hasher(5), np.zeros(counters, np.uint32)
        for batch in batches:
            for _, _, w in each(batch.column(0), case=LOWER):
                at, n = np.unique(shingles(w, words, runs, size)[0] % U(counters), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
        for c in range(counters // CHUNK):
            if (part := total[c * CHUNK : (c + 1) * CHUNK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["c", "n"])

    return count


def _summed(group: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.uint64)
    for x in group.column("n").to_pylist():
        total += np.frombuffer(x, np.uint32)
    return pa.table({"c": group.column("c")[:1], "n": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})


ENTRY = np.dtype([("h", "u8"), ("key", "i8"), ("comp", "i8"), ("n", "i4"), ("i", "i4"), ("block", "i8")])


def _prefixer(size: int, percent: int, parts: int, block: int, counters):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, runs, often = Hasher(1), Hasher(5), np.frombuffer(counters.value, np.uint32)
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held)
            held.clear()
            to = mix(x["h"] + x["block"].astype(U)) % U(parts)
            x = x[np.argsort(to, kind="stable")]
            to.sort()
            for p, one in zip(np.unique(to), np.split(x, np.flatnonzero(np.diff(to)) + 1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([one.tobytes()], pa.binary())], ["part", "entries"])

        for batch in batches:
            keys, comps = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            for low, high, w in each(batch.column(2), case=LOWER):
                h, text = shingles(w, words, runs, size)
                df = often[(h % U(len(often))).astype(np.int64)].astype(np.int64)
                order = np.lexsort((h, df, text))
                h, df = h[order], df[order]
                n = np.bincount(text, minlength=high - low)
                i = np.arange(len(h)) - np.concatenate([[0], np.cumsum(n)])[:-1][text]
                some = (i < n[text] - -(-percent * n[text] // 100) + 1) & (df > 1)
                e = np.zeros(int(some.sum()), ENTRY)
                e["h"], e["key"], e["comp"], e["n"], e["i"] = h[some], keys[low + text[some]], comps[low + text[some]], n[text[some]], i[some]
                blocks = df[some] // block + 1
                held.append(e[blocks == 1])
                for b in np.unique(blocks[blocks > 1]):  # every two blocks of a frequent shingle meet once
                    hot = e[blocks == b]
                    own = mix(hot["key"].view(U)) % U(b)
                    for other in range(int(b)):
                        copy = hot.copy()
                        copy["block"] = 1 + np.minimum(own, U(other)) * U(b) + np.maximum(own, U(other))
                        held.append(copy)
            if sum(map(len, held)) > 1_000_000:
                yield from flush()
        if held:
            yield from flush()

    return prefixes


def _matcher(percent: int):
    def match(group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group.column("entries").to_pylist()), ENTRY)
        x = x[np.lexsort((x["n"], x["block"], x["h"]))]
        new = np.flatnonzero((x["h"][1:] != x["h"][:-1]) | (x["block"][1:] != x["block"][:-1])) + 1
        edges = np.concatenate([[0], new, [len(x)]])
        found: list[np.ndarray] = []
        for k in np.flatnonzero(np.diff(edges) > 1):
            run = x[edges[k] : edges[k + 1]]
            if (run["comp"] == run["comp"][0]).all():
                continue
            n, left = run["n"].astype(np.int64), (run["n"] - run["i"]).astype(np.int64)
            for a in range(len(run)):
                # b has as many shingles as a or more, but not too many
                end = np.searchsorted(n, 100 * n[a] // percent, "right")
                b = slice(a + 1, end)
                need = -(-percent * (n[a] + n[b]) // (100 + percent))
                ok = (np.minimum(left[a], left[b]) >= need) & (run["comp"][b] != run["comp"][a])
                if ok.any():
                    y = run["key"][b][ok]
                    found.append(np.stack([np.minimum(y, run["key"][a]), np.maximum(y, run["key"][a])]))
        pairs = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    return match


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, miss: float = 1e-5, seed: int = 17, block: int = BLOCK, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, same (a hash of the text), n_shingles, component_id (the smallest key that it can reach by links of
    ``percent`` or more) and stays, which holds for one text under one key in each component."""
    spark = docs.sparkSession
    texts = docs.select(id_key(key).alias("key"), text_hash(text).alias("same"), F.col(text).cast("string").alias("text"))
    sketches = stored(texts.mapInArrow(_sketcher(size, bands * rows, seed), "key long, same long, n long, f1 long, f2 long, sig binary"), "sketches")
    sketches = sketches.withColumn("id", F.when(F.col("n") > 0, F.xxhash64("f1", "f2", "n")).otherwise(F.xxhash64("key", "same")))
    classes = stored(sketches.where("n > 0").groupBy("id").agg(F.min(F.struct("key", "same")).alias("rep")), "classes")
    chosen = classes.select("id", "rep.key", "rep.same")
    reps = chosen.join(sketches.select("key", "same", "sig"), ["key", "same"]).select(F.col("id").alias("key"), F.col("key").alias("doc"), "sig").dropDuplicates(["key"])
    banded = reps.select("key", "doc", F.explode(F.array(*(F.xxhash64(F.lit(i), F.substring("sig", 4 * rows * i + 1, 4 * rows)) for i in range(bands)))).alias("band"))
    firsts = banded.groupBy("band").agg(F.min_by("key", "doc").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    buckets = stored(banded.join(firsts, "band").select("band", "a", F.col("key").alias("b")), "buckets")
    pairs = buckets.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    signed = pairs.join(reps.select(F.col("key").alias("a"), F.col("sig").alias("x")), "a").join(reps.select(F.col("key").alias("b"), F.col("sig").alias("y")), "b")
    likely = signed.select("a", "b", "x", "y").mapInArrow(_pruner(bands * rows, percent / 100, miss), "a long, b long")
    chosen = chosen.join(buckets.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
    near = texts.where("text is not null").join(chosen.hint("shuffle_hash"), ["key", "same"])
    near = stored(near.select(F.col("id").alias("key"), "text").dropDuplicates(["key"]), "near")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(near.select(F.col("key").alias("b"), F.col("text").alias("y")), "b").join(near.select(F.col("key").alias("a"), F.col("text").alias("x")), "a")
        return both.select("a", "b", "x", "y").mapInArrow(_verifier(size, percent), "a long, b long")

    links = stored(verified(likely), "links")
    found = components(links)
    marked = buckets.join(found.select(F.col("id").alias("b"), "component"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    mixed = marked.groupBy("band").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("band")
    open_ = marked.join(mixed, "band", "left_semi").groupBy(F.col("b").alias("key")).agg(F.first("component").alias("component"))
    rest = stored(near.join(open_, "key").select("key", "component", "text"), "open")
    held = rest.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = np.zeros(min(MOST_COUNTERS, max(CHUNK, 1 << int(held // PER_COUNTER).bit_length())), np.uint32)
    for row in rest.select("text").mapInArrow(_counter(size, len(counters)), "c int, n binary").groupBy("c").applyInArrow(_summed, "c int, n binary").collect():  # at most MOST_COUNTERS / CHUNK rows of fixed size
        counters[row.c * CHUNK : (row.c + 1) * CHUNK] = np.frombuffer(row.n, np.uint32)
    entries = rest.mapInArrow(_prefixer(size, percent, shares(rest, 2), block, spark.sparkContext.broadcast(counters.tobytes())), "part int, entries binary")
    pairs = entries.groupBy("part").applyInArrow(_matcher(percent), "a long, b long").distinct()
    more = stored(verified(pairs), "links")
    found = classes.join(components(links.union(more)), "id", "left").select("id", "rep", F.coalesce("component", "id").alias("component"))
    firsts = found.groupBy("component").agg(F.min("rep").alias("first"))
    out = sketches.select("id", "key", "same", "n").join(found.join(firsts, "component").select("id", "first"), "id", "left")
    first = F.when(F.col("n") > 0, F.col("first")).otherwise(F.struct("key", "same"))
    return out.select("key", "same", F.col("n").alias("n_shingles"), first["key"].alias("component_id"), (first == F.struct("key", "same")).alias("stays"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("key").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), F.col("stays").alias("kept"))


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT id, b FROM r JOIN e ON reached = a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(reached) AS component_id, min(reached) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n
"""


def brute_force(docs: list[tuple[int, str | None]], size: int = 5, percent: int = 75) -> list[tuple[int, int, int, bool]]:
    """All pairs by their words, for small inputs."""
    sets = {}
    for x, t in docs:
        w = bytes(LOWER[np.frombuffer((t or "").encode(), np.uint8)]).split()
        sets[x] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    up = {x: x for x in sets}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids, where = sorted(sets), {}
    for x in ids:
        seen: dict[int, int] = {}
        for s in sets[x]:
            for y in where.setdefault(s, []):
                seen[y] = seen.get(y, 0) + 1
            where[s].append(x)
        for y, both in seen.items():
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    return [(x, len(sets[x]), root(x), root(x) == x) for x in ids]
