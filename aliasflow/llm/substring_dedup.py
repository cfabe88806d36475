"""Substring deduplication: Rabin-Karp fingerprints of every window of ``size`` words, counted over the corpus.

Each task fingerprints the windows of its documents and keeps the first of equal ones, so that a window which a third
of all documents share costs one entry a task.  The entries are dealt out by fingerprint as packed arrays, hundreds of
thousands to a row; there, all but the earliest occurrence of a fingerprint are found.  The starts found return,
packed as well, to the buckets of their documents, where overlapping windows merge into maximal intervals of words to
remove.

* A null text has no words.  A text of fewer than ``size`` words has no window and loses nothing.
* Rows that share doc_id and text are one document given more than once: an occurrence at the same start is the same
  occurrence, and each row gets its own result.  Different texts under one doc_id, or without one, are documents of
  their own, in order of a hash of the text that is their second key; a null doc_id comes after all others.  Windows
  carry the hash only where a table of bits of fixed size says that it may be needed.
* Other columns, whatever their names, are kept by :func:`substring_dedup` unless they bear a name it adds.
* Windows are equal if their 64-bit fingerprints and the parts that an independent one deals them to are; as parts
  grow in number with the input, false matches stay improbable: n * n / 2**65 / parts for n windows.
* Parts, and what a task holds before it deals it out, grow with the square root of the input, so that the rows between
  them grow as the input does.
* Entries travel in byte planes of differences, texts compressed, so that shuffles stay small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, id_key, input_bytes, shares, spread, table, text_hash
from .wordprints import Hasher, U, each, mix

#: Windows that a task holds before it deals them out, at least, and bytes of input for each about.
HELD, WINDOW = 1_500_000, 4
#: Bytes of input that make about 16 windows of a flush in a part, or more.
ROW = 64
PACKED = "part int, h binary, docs binary, sames binary, starts binary"
#: Bits of the table of ids that stand for more than one text, and of one of the bitmaps it is made of.
SLOTS, BITMAP = 1 << 23, 1 << 15


def _planes(x: np.ndarray) -> bytes:
    """Differences, all lowest bytes first: what is small or regular compresses well."""
    x = np.diff(x, prepend=x.dtype.type(0))
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _unplanes(x: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def _bucket(doc: np.ndarray, same: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.view(U) ^ mix(same.view(U), 5)) % U(parts)).astype(np.int32)


def _order(doc: np.ndarray, same: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return np.lexsort((pos, same, doc) if same.any() else (pos, doc))


def _packed(to: np.ndarray, parts: int, doc: np.ndarray, same: np.ndarray, pos: np.ndarray, h: np.ndarray | None = None) -> Iterator[tuple]:
    """Windows in order of document and start, as one row for each part they go to; no hash is written where all are 0."""
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        own = order[cut[p] : cut[p + 1]]
        new = np.ones(len(own), bool)
        new[1:] = (doc[own[1:]] != doc[own[:-1]]) | (same[own[1:]] != same[own[:-1]])
        begin = np.flatnonzero(new)
        ids = np.stack([doc[own[begin]], np.diff(begin, append=len(own))])
        hashes = same[own[begin]]
        yield int(p), None if h is None else h[own].tobytes(), _planes(ids.ravel()), _planes(hashes) if hashes.any() else b"", _planes(pos[own].astype(np.uint32))


def _unpacked(docs: bytes, sames: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, n = _unplanes(docs, np.int64).reshape(2, -1)
    hashes = _unplanes(sames, np.int64) if sames else np.zeros(len(ids), np.int64)
    return np.repeat(ids, n), np.repeat(hashes, n), _unplanes(starts, np.uint32)


def _later(h: np.ndarray, doc: np.ndarray, same: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether a window comes after an equal one; all must be in order of document and start."""
    order = np.argsort(h, kind="stable")
    h, doc, same, pos = h[order], doc[order], same[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = np.empty(len(h), bool)
    later[order] = (doc != doc[first]) | (same != same[first]) | (pos != pos[first])
    return later


def _keys(batch: pa.RecordBatch, shared: np.ndarray, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The two keys of each document from its columns key, same and slot: the hash is 0 where the id has but one text."""
    key, same, slot = (batch.column(at + i).to_numpy(zero_copy_only=False) for i in range(3))
    needed = (key == NO_ID) | ((shared[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
    return key.astype(np.int64), np.where(needed, same, 0).astype(np.int64)


def _dealer(size: int, parts: int, held_most: int, shared):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, runs, other = Hasher(1), Hasher(11), Hasher(21)
        bits = np.frombuffer(shared.value, np.uint8)
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, to, doc, same, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = _order(doc, same, pos)
            h, to, doc, same, pos = h[order], to[order], doc[order], same[order], pos[order]
            later = _later(h ^ to.astype(U), doc, same, pos)
            lost, hashes, kept = doc[later], same[later], ~later
            rows = [*_packed(_bucket(lost, hashes, parts), parts, lost, hashes, pos[later]), *_packed(to[kept], parts, doc[kept], same[kept], pos[kept], h[kept])]
            for low in range(0, len(rows), 64):
                part, *rest = zip(*rows[low : low + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in rest)], ["part", "h", "docs", "sames", "starts"])

        count = 0
        for batch in batches:
            ids, sames = _keys(batch, bits)
            for low, _, w in each(batch.column(3)):
                first, text = w.windows(size)
                if not len(first):
                    continue
                f = words.of_words(w.data, w.start, w.end)
                held.append((runs.of_runs(f, first, size), (other.of_runs(f, first, size) % U(parts)).astype(np.int32), ids[low + text], sames[low + text], first - w.bounds[text]))
                count += len(first)
                if count >= held_most:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()

    return deal


def _judge(parts: int):
    def judge(group: pa.Table) -> pa.Table:
        """Of all windows of one part, those that come later, by buckets of documents; what tasks found before passes through."""
        found, held = [], []
        for part, h, *rest in zip(*(x.to_pylist() for x in group.columns), strict=True):
            if h is None:
                found.append((part, *rest))
            else:
                held.append((np.frombuffer(h, np.uint64), *_unpacked(*rest)))
        if held:
            h, doc, same, pos = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            order = _order(doc, same, pos)
            h, doc, same, pos = h[order], doc[order], same[order], pos[order]
            later = _later(h, doc, same, pos)
            doc, same, pos = doc[later], same[later], pos[later]
            found += [(p, *rest) for p, _, *rest in _packed(_bucket(doc, same, parts), parts, doc, same, pos)]
        to, *rest = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.Table.from_arrays([pa.array(to, pa.int32()), *(pa.array(x, pa.binary()) for x in rest)], ["bucket", "docs", "sames", "starts"])

    return judge


def _squeeze(parts: int, shared):
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts compressed after their length, and the keys and buckets of the documents."""
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            key, same = _keys(batch, bits, 1)
            raw = [(x or "").encode() for x in batch.column(4).to_pylist()]
            text = pa.array([len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), pa.array(same), text, pa.array(_bucket(key, same, parts))], ["row", "key", "same", "text", "bucket"])

    return squeeze


def _remover(size: int, names: list[str]):
    def remove(docs: pa.Table, found: pa.Table) -> pa.Table:
        """Of one bucket of documents: merge windows into intervals and cut them out."""
        held = [_unpacked(*x) for x in zip(*(found.column(c).to_pylist() for c in ("docs", "sames", "starts")), strict=True)]
        doc, same, pos = map(np.concatenate, zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((same, doc))
        doc, same, pos = doc[order], same[order], pos[order].astype(np.int64)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (same[1:] != same[:-1])
        begin = np.flatnonzero(new)
        where = dict(zip(zip(doc[begin].tolist(), same[begin].tolist(), strict=True), np.split(pos, begin[1:]), strict=False))
        kept, removed, n, spans = [], [], [], []
        for key, hashed, text in zip(*(docs.column(c).to_pylist() for c in ("key", "same", "text")), strict=True):
            own = pa.decompress(text[8:], int.from_bytes(text[:8], "little"), "zstd", asbytes=True).split()
            at = where.get((key, hashed), pos[:0])
            at = at[at + size <= len(own)]
            out = np.bincount(at, minlength=len(own) + 1) - np.bincount(at + size, minlength=len(own) + 1)
            gone = np.cumsum(out) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
            n.append(len(own))
            removed.append(int(gone.sum()))
            kept.append(b" ".join(own[i] for i in np.flatnonzero(~gone[:-1])).decode() if removed[-1] else b" ".join(own).decode())
            spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.Table.from_arrays([docs.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)], names)

    return remove


def _shared_ids(texts: DataFrame) -> bytes:
    """A bit for each slot of an id that stands for more than one text; an id that shares its slot only carries a hash too many."""
    several = texts.where(F.col("key") != NO_ID).groupBy("key", "slot").agg(F.min("same").alias("a"), F.max("same").alias("b")).where("a < b")
    bits = np.zeros(SLOTS // 8, np.uint8)
    marked = several.groupBy(F.expr(f"slot div {BITMAP}").alias("at")).agg(F.bitmap_construct_agg(F.expr(f"slot % {BITMAP}").cast("long")).alias("bits"))
    for row in marked.collect():  # SLOTS / BITMAP rows of fixed size
        bits[row["at"] * BITMAP // 8 : (row["at"] + 1) * BITMAP // 8] = np.frombuffer(row.bits, np.uint8)
    return bits.tobytes()


def substring_dedup(docs: DataFrame, size: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with n_words, n_removed, kept_text and removed (intervals of words, end exclusive)."""
    parts = shares(docs, 5, ROW)
    held = max(HELD, size_ // parts // WINDOW if (size_ := input_bytes(docs)) < 1 << 60 else 0)
    keys = [id_key(key).alias("key"), text_hash(text).alias("same"), F.pmod(F.xxhash64(id_key(key)), F.lit(SLOTS)).alias("slot")]
    shared = docs.sparkSession.sparkContext.broadcast(_shared_ids(docs.select(*keys)))
    keyed = docs.select(*keys, F.col(text).cast("string").alias("t"))
    windows = spread(keyed.mapInArrow(_dealer(size, parts, held, shared), PACKED), 16, docs, "part")
    found = windows.groupBy("part").applyInArrow(_judge(parts), "bucket int, docs binary, sames binary, starts binary")
    added = ["n_words", "n_removed", "kept_text", "removed"]
    rest = [x for x in docs.columns if x not in (text, *added)]
    whole = docs.select(F.struct(*(F.col(f"`{x}`") for x in rest)).alias("row"), *keys, F.col(text).cast("string").alias("text"))
    squeezed = T.StructType([*whole.schema.fields[:3], T.StructField("text", T.BinaryType()), T.StructField("bucket", T.IntegerType())])
    schema = T.StructType([whole.schema["row"], *T.StructType.fromDDL("n_words long, n_removed long, kept_text string, removed array<struct<start: long, end: long>>")])
    whole = whole.mapInArrow(_squeeze(parts, shared), squeezed)
    out = spread(whole, 32, docs, "bucket").groupBy("bucket").cogroup(spread(found, 32, docs, "bucket").groupBy("bucket")).applyInArrow(_remover(size, ["row", *added]), schema)
    return out.select("row.*", *added)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS r FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE r > 1),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM k ANTI JOIN c USING (doc_id, j) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""


def brute_force(docs: list[tuple[int, str | None]], size: int = 20) -> list[tuple[int, int, int, str]]:
    """The same by comparing the words themselves, for small inputs."""
    seen: dict[tuple, tuple[int, int]] = {}
    split = {x: (t or "").encode().split() for x, t in docs}
    for x in sorted(split):
        for i in range(len(split[x]) - size + 1):
            seen.setdefault(tuple(split[x][i : i + size]), (x, i))
    out = []
    for x, own in split.items():
        gone = {j for i in range(len(own) - size + 1) if seen[tuple(own[i : i + size])] != (x, i) for j in range(i, i + size)}
        kept = b" ".join(w for j, w in enumerate(own) if j not in gone)
        out.append((x, len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
