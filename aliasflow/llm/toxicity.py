"""Toxicity by cumulative-link ordinal regression on sparse text features.

A document's severity grade g in 0..K-1 follows P(g >= k) = sigmoid(w . x - t_k), one weight vector shared by the
ordered thresholds t_1 < ... < t_{K-1}; the expected severity is the sum of these probabilities.  Features are the
presence of a document's words and of their beginnings of four to six bytes, hashed.  Weights are not
negative, so no text makes up for an insult, and an L1 penalty leaves few above zero, so long texts do not add up noise.

Fitting takes, of each label, the ``sample`` labelled documents of smallest hash, each label weighing what it weighs
among all labelled documents.  Labels say toxic or not; a toxic document's grade is 2 if it holds more different
words telling of toxicity than the median of the toxic sample, else 1.  Scoring is one scan without a shuffle.

* Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased.  A null text has no words: its score
  is that of the thresholds alone, which is grade 0 when any clean document was seen.
* A doc_id with several labels counts by the largest.  Labels without a document, or null, are left out.  Without any
  toxic label, or without any other, nothing is told apart: all documents have severity 0.
* Rows are scored one by one; repeated rows repeat, other columns are kept, and no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .wordprints import LOWER, Hasher, U, Words, each

BITS = 20
SEPARATES = np.array([c < 0x80 and not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A) for c in range(256)])


def features(w: Words, hasher: Hasher) -> np.ndarray:
    """For each word: hashed features of the whole and of its beginnings."""
    ends = [w.end, *(np.minimum(w.end, w.start + n) for n in (4, 5, 6))]
    return np.stack([(hasher.of_words(w.data, w.start, e) + U(i)) % U(1 << BITS) for i, e in enumerate(ends)], 1).astype(np.int64)


@dataclass
class Model:
    """The weights other than zero, the features they belong to, and the thresholds."""

    at: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _descend(of: np.ndarray, doc: np.ndarray, width: int, grade: np.ndarray, share: np.ndarray, grades: int, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proximal gradient (FISTA) on the weighted mean negative log-likelihood, from zero weights."""
    above = np.array([share[grade >= k].sum() for k in range(1, grades)])
    w, t = np.zeros(width), np.log((1 - above + 1e-4) / (above + 1e-4))
    per = np.maximum(np.bincount(of, share[doc], width), 1e-12)
    size = np.bincount(doc, minlength=1).max() if len(doc) else 1
    rate_w, rate_t = 1.0 / (0.5 * per * max(1.0, np.sqrt(size))), 1.0
    v, u, momentum = w.copy(), t.copy(), 1.0
    lower, upper = np.maximum(grade - 1, 0), np.minimum(grade, grades - 2)
    for _ in range(steps):
        s = np.bincount(doc, v[of], len(grade)) if len(doc) else np.zeros(len(grade))
        up = np.where(grade > 0, _sigmoid(s - u[lower]), 1.0)
        down = np.where(grade < grades - 1, _sigmoid(s - u[upper]), 0.0)
        gap = np.maximum(up - down, 1e-9)
        a, b = np.where(grade > 0, up * (1 - up), 0.0), down * (1 - down)
        grad_t = np.bincount(lower, share * a / gap, grades - 1) - np.bincount(upper, share * b / gap, grades - 1)
        step = v - rate_w * np.bincount(of, (-share * (a - b) / gap)[doc], width) if len(doc) else v
        new_w = np.maximum(step - rate_w * l1, 0)
        new_t = np.maximum.accumulate(u - rate_t * grad_t + np.arange(grades - 1) * 1e-6)
        new_m = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, u = new_w + (momentum - 1) / new_m * (new_w - w), np.maximum.accumulate(new_t + (momentum - 1) / new_m * (new_t - t))
        w, t, momentum = new_w, new_t, new_m
    return w, t


def fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, weight: np.ndarray, grades: int, l1: float = 3e-4, again: float = 2e-5, steps: int = 300) -> Model:
    """Select features by a strong penalty ``l1``, then fit those selected with a weak one."""
    share = weight / weight.sum()
    # screening: features more frequent in grades above 0 than chance makes them, that occur at least twice
    hits, n = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for x, g in zip(rows, grade, strict=True):  # the features of a row are distinct
        n[x] += 1
        hits[x] += g > 0
    rate = (grade > 0).mean()
    seen = np.flatnonzero((n >= 2) & (hits - n * rate > 3 * np.sqrt(n * rate * (1 - rate) + 1e-9)))
    del hits, n
    place = np.full(1 << BITS, -1, np.int32)
    place[seen] = np.arange(len(seen))
    found = [place[x] for x in rows]
    found = [x[x >= 0] for x in found]
    doc, of, keep = np.repeat(np.arange(len(rows)), [len(x) for x in found]), np.concatenate(found), np.ones(len(seen), bool)
    thresholds = weights = None
    for penalty in (l1, again):
        some = keep[of]
        of, doc, seen = (np.cumsum(keep) - 1)[of[some]], doc[some], seen[keep]
        weights, thresholds = _descend(of, doc, len(seen), grade, share, grades, penalty, steps)
        keep = weights != 0
    return Model(seen[keep], weights[keep].astype(np.float32), thresholds)


def _featuriser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, text -> toxic, distinct features, and the number of words and the whole words' features."""
    hasher = Hasher(61)
    for batch in batches:
        for low, high, w in each(batch.column(1), SEPARATES, LOWER):
            x = features(w, hasher)
            out = [(np.unique(x[a:b]).astype(np.uint32).tobytes(), x[a:b, 0].astype(np.uint32).tobytes()) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array(y, pa.binary()) for y in zip(*out, strict=True))], ["toxic", "distinct", "words"])


def _fitter(counts: dict[int, int], grades: int):
    """Fit the sample that arrives in one task; nothing comes out of it if it holds one label only."""

    def fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rows, words = [], [], []
        for batch in _featuriser(batches):
            labels += batch.column("toxic").to_pylist()
            rows += [np.frombuffer(x, np.uint32) for x in batch.column("distinct").to_pylist()]
            words += [np.frombuffer(x, np.uint32) for x in batch.column("words").to_pylist()]
        toxic = np.array(labels, np.int64)
        if len(set(labels)) < 2:
            return
        # words telling of toxicity: at least ten times as frequent, by documents, among the toxic
        seen = np.zeros((2, 1 << BITS), np.float32)
        for x, y in zip(words, toxic, strict=True):
            seen[y, np.unique(x)] += 1
        telling = (seen[1] >= 3) & (seen[1] / (toxic == 1).sum() >= 10 * seen[0] / (toxic == 0).sum())
        told = np.array([telling[np.unique(x)].sum() for x in words])
        grade = toxic
        if grades > 2:
            grade = np.where((toxic > 0) & (told > np.median(told[toxic > 0])), 2, grade)
        model = fit_ordinal(rows, grade, np.array([counts[k] / (toxic == k).sum() for k in labels]), grades)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.at.astype(np.int64), model.weights, model.thresholds.astype(float))], ["at", "weights", "thresholds"])

    return fit_sample


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, grades: int = 3, text: str = "text", key: str = "doc_id") -> Model | None:
    marked = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = marked.join(docs.select(F.col(key).alias("k")), "k", "left_semi")
    counts = dict(known.groupBy("toxic").count().collect())  # two rows
    if len(counts) < 2:
        return None
    picked = None
    for toxic in (0, 1):
        # a share of them by hash, so that no task sends or sorts more than a few samples
        share = min(1.0, 4 * sample / counts[toxic])
        some = known.where((F.col("toxic") == toxic) & (F.pmod(F.xxhash64("k"), F.lit(1 << 32)) <= F.lit(int(share * (1 << 32))))).orderBy(F.xxhash64("k"), "k").limit(sample)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "k").select("k", "toxic", "text").orderBy("k").limit(2 * sample).select("toxic", "text")
    # the sample is bounded, and so is the one task that fits it; a few hundred weights come back
    found = texts.repartition(1).mapInArrow(_fitter(counts, grades), "at binary, weights binary, thresholds binary").first()
    if found is None:
        return None
    return Model(np.frombuffer(found.at, np.int64), np.frombuffer(found.weights, np.float32), np.frombuffer(found.thresholds, np.float64))


def _scorer(weights: np.ndarray, at: np.ndarray, thresholds: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, dense = Hasher(61), np.zeros(1 << BITS, np.float32)
        dense[at] = weights
        for batch in batches:
            for low, high, w in each(batch.column(1), SEPARATES, LOWER):
                x = features(w, hasher)
                word, which = np.nonzero(dense[x])
                owner = np.searchsorted(w.bounds, word, "right") - 1
                once = np.unique(owner << BITS | x[word, which])
                s = np.bincount(once >> BITS, dense[once & (1 << BITS) - 1].astype(float), high - low)
                p = _sigmoid(s[:, None] - thresholds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int64)), pa.array(p[:, 0])], ["row", "severity", "grade", "p_toxic"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 3000, grades: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with severity (expected grade), grade (thresholds passed at even odds) and p_toxic; columns of these names are replaced."""
    added = ["severity", "grade", "p_toxic"]
    rest = [x for x in docs.columns if x not in added]
    whole = docs.select(F.struct(*(F.col(f"`{x}`") for x in rest)).alias("row"), F.col(text).cast("string").alias("t"))
    model = fit(docs, labels, sample, grades, text, key)
    if model is None:
        return docs.select(*(F.col(f"`{x}`") for x in rest), F.lit(0.0).alias("severity"), F.lit(0).cast("long").alias("grade"), F.lit(0.0).alias("p_toxic"))
    schema = T.StructType([whole.schema["row"], *T.StructType.fromDDL("severity double, grade long, p_toxic double")])
    return whole.mapInArrow(_scorer(model.weights, model.at, model.thresholds), schema).select("row.*", *added)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("severity", 6).alias("severity"), "grade", F.round("p_toxic", 6).alias("p_toxic"), (F.col("grade") > 0).alias("toxic"))
