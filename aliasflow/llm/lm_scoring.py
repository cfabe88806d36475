"""Language-model scoring by a weighted backoff automaton over smoothed n-grams.

The model interpolates n-grams of up to ``order`` words, each order drawn to the one below by a Dirichlet prior:

    p(w | h) = (c(hw) + s * p(w | h')) / (c(h) + s),     p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

A state is a history that training documents hold; the empty one is the root.  A seen n-gram hw is an arc of h on w that
weighs log p(w | h) and leads to the longest suffix of hw that is a state.  Where a state has no arc on a token, its
failure arc of weight log s / (c(h) + s) leads to its longest proper suffix; the root has an arc on every token.

The automaton grows with the corpus and is never held in one place.  Documents are dealt into blocks.  Each block asks,
once for each distinct n-gram in it, for its count in the corpus, and in the same breath says how often the block's
training documents hold it; requests are dealt by fingerprint, summed, and answered.  With the answers a block builds the
states, arcs and failure arcs that its documents can reach, and walks them from left to right: texts are cut into
segments, all segments of a block take a step at a time, each carrying its state and its sum of log-probabilities.  A
segment that begins inside a text first reads the words before it, from which the state follows.  An arc bears the number
of its n-gram in the block, so that a state finds its arc on the next token by one look-up.

* A null text is empty: its only token is the end of text.  A document whose key is null trains the model.
* Rows are scored one by one, so repeated rows count, and are returned, as often as they are given.  No documents give
  no rows.  Other columns, whatever their names, are kept, but for the text and those that bear an added name.
* N-grams are told apart by ``BITS`` bits, the highest of which name the part they are dealt to, so that scores do not
  depend on the number of parts.
* Blocks and parts grow with the square root of the input, so that the rows between them grow as the input does.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scan_number, shares, spread, stored, table, text_hash
from .wordprints import LOWER, Hasher, U, each

END = U(0x9E3779B97F4A7C15)
ANSWERS = "block int, part int, c1 binary, ck binary, vocabulary long, tokens long"
#: Bits of an n-gram's fingerprint: of a million million n-grams, one in a million shares its count with another.
BITS = 60
#: Tokens of a segment.
SEGMENT = 256
#: Bytes of input that make about 16 n-grams of a block in a part, or more.
ROW = 32


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed after their length, so that they travel small."""
    for batch in batches:
        raw = [x.encode() for x in batch.column(2).to_pylist()]
        text = pa.array([len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, batch.column(3)], ["row", "held_out", "text", "block"])


def _texts(column: pa.ChunkedArray) -> pa.Array:
    return pa.array([pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in column.to_pylist()], pa.binary()).cast(pa.string())


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all tokens, each text's words followed by its end, and where each text begins."""
    words, found, counts = Hasher(1), [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for _, _, w in each(texts, case=LOWER):
        found.append(np.insert(words.of_words(w.data, w.start, w.end), w.bounds[1:], END))
        counts.append(w.counts() + 1)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


@dataclass
class Grams:
    """The distinct n-grams of one length in a block, in order of their fingerprints."""

    prints: np.ndarray
    #: Of each position of the block: the place of the n-gram that ends there, -1 where a text has too few tokens.
    place: np.ndarray
    #: A position where each ends.
    example: np.ndarray


def _grams(f: np.ndarray, bounds: np.ndarray, order: int) -> list[Grams]:
    runs, out = Hasher(31), []
    at = np.arange(len(f)) - np.repeat(bounds[:-1], np.diff(bounds))
    for k in range(1, order + 1):
        end = np.flatnonzero(at >= k - 1)
        prints, first, own = np.unique(runs.of_runs(f, end - k + 1, k) >> U(64 - BITS), return_index=True, return_inverse=True)
        place = np.full(len(f), -1, np.int32)
        place[end] = own
        out.append(Grams(prints, place, end[first]))
    return out


def _longer(grams: list[Grams]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all n-grams but single words, in order, and the length of each."""
    prints = np.concatenate([g.prints for g in grams[1:]] or [np.zeros(0, U)])
    order = np.argsort(prints, kind="stable")
    return prints[order], np.repeat(np.arange(1, len(grams)), [len(g.prints) for g in grams[1:]])[order]


def _planes(x: np.ndarray, width: int) -> bytes:
    """All lowest bytes first, compressed, after their length."""
    raw = x.view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :width].T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unplanes(x: bytes, width: int, kind: type) -> np.ndarray:
    raw = pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) if x else b""
    out = np.zeros((len(raw) // width, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view(kind).ravel()


def _asker(order: int, bits: int):
    low = U((1 << BITS - bits) - 1)

    def ask(group: pa.Table) -> pa.Table:
        """The requests of one block: for each part, its n-grams in ascending order, and their counts here."""
        f, bounds = _tokens(_texts(group.column("text")))
        train = np.repeat(~group.column("held_out").to_numpy(), np.diff(bounds))
        grams = _grams(f, bounds, order)
        count = [np.bincount(g.place[train & (g.place >= 0)], minlength=len(g.prints)).astype(np.uint32) for g in grams]
        both, length = _longer(grams)
        counted = np.zeros(len(both), np.uint32)
        for k in range(1, order):
            counted[length == k] = count[k]
        out: dict[int, list] = {}
        for kind, (h, n) in enumerate(((grams[0].prints, count[0]), (both, counted))):
            to = h >> U(BITS - bits)
            cut = np.searchsorted(to, np.arange((1 << bits) + 1, dtype=U))
            for p in np.flatnonzero(np.diff(cut)):
                own = slice(cut[p], cut[p + 1])
                out.setdefault(int(p), [b""] * 4)[2 * kind : 2 * kind + 2] = [_planes(np.diff(h[own] & low, prepend=U(0)), 8), _planes(n[own], 4)]
        block = group.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(out), pa.int32()), "part": pa.array(list(out), pa.int32()), **{x: pa.array([y[i] for y in out.values()], pa.binary()) for i, x in enumerate(("h1", "n1", "hk", "nk"))}})

    return ask


def _answer(group: pa.Table) -> pa.Table:
    """Sum the counts of one part, and give each block those of its n-grams."""
    counts: list[list[bytes]] = []
    vocabulary = tokens = 0
    for kind, (hs, ns) in enumerate((("h1", "n1"), ("hk", "nk"))):
        h = [np.cumsum(_unplanes(x, 8, np.uint64), dtype=U) for x in group.column(hs).to_pylist()]
        n = np.concatenate([_unplanes(x, 4, np.uint32) for x in group.column(ns).to_pylist()])
        sizes = np.cumsum([len(x) for x in h])
        _, place = np.unique(np.concatenate(h), return_inverse=True)
        total = np.bincount(place, n).astype(np.uint64) if len(place) else np.zeros(0, np.uint64)
        if kind == 0:
            vocabulary, tokens = int((total > 0).sum()), int(total.sum())
        counts.append([_planes(x, 8) for x in np.split(total[place], sizes[:-1])])
    rows = group.num_rows
    zero = [0] * (rows - 1)
    return pa.table({"block": group.column("block"), "part": group.column("part"), "c1": pa.array(counts[0], pa.binary()), "ck": pa.array(counts[1], pa.binary()), "vocabulary": pa.array([vocabulary, *zero], pa.int64()), "tokens": pa.array([tokens, *zero], pa.int64())})


@dataclass
class Automaton:
    """States are numbers from 0, the root.  Arcs bear the numbers of the block's n-grams, shorter ones first."""

    #: The number of the first n-gram of each length, and whether each n-gram is an arc.
    first: np.ndarray
    seen: np.ndarray
    weight: np.ndarray
    leads: np.ndarray
    #: Of each state: how many tokens it holds, where its failure arc leads, and what that weighs.
    depth: np.ndarray
    fails: np.ndarray
    fail_weight: np.ndarray

    def step(self, state: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and log10 probability after each of many states has read its next token: failure arcs up to the first
        state with an arc on it, then that arc.  ``places`` has, for each length, the n-gram that the token ends."""
        at, total = state.copy(), np.zeros(len(state))
        depth = self.depth[at]
        arc = self.first[depth] + places[depth, np.arange(len(at))]
        open_ = np.flatnonzero(~self.seen[arc])
        while len(open_):
            total[open_] += self.fail_weight[at[open_]]
            at[open_] = self.fails[at[open_]]
            depth = self.depth[at[open_]]
            arc[open_] = self.first[depth] + places[depth, open_]
            open_ = open_[~self.seen[arc[open_]]]
        return self.leads[arc], total + self.weight[arc]


def build(grams: list[Grams], counts: list[np.ndarray], strengths: tuple[float, ...], total: int, vocabulary: int) -> Automaton:
    """Of the n-grams of a block and how often training documents hold each."""
    order = len(grams)
    # the state of each n-gram shorter than the longest, 0 where none holds it
    state, states = [], 1
    for c in counts[: order - 1]:
        seen = c > 0
        state.append(np.where(seen, states + np.cumsum(seen) - 1, 0).astype(np.int32))
        states += int(seen.sum())
    fails, fail_weight, depth = np.zeros(states, np.int32), np.zeros(states), np.zeros(states, np.int8)
    p = (counts[0] + 0.5) / (total + 0.5 * (vocabulary + 1))
    # the root has an arc on every token, which leads back to it if no training document holds that
    weight, leads = [np.log10(p)], [state[0] if state else np.zeros(len(p), np.int32)]
    for k in range(1, order):
        own, c, s = grams[k], counts[k], strengths[k - 1]
        before, suffix = grams[k - 1].place[own.example - 1], grams[k - 1].place[own.example]
        p = (c + s * p[suffix]) / (counts[k - 1][before] + s)
        weight.append(np.log10(p))
        leads.append(state[k] if k < order - 1 else state[k - 1][suffix])
        known = np.flatnonzero(counts[k - 1] > 0)
        at = state[k - 1][known]
        depth[at] = k
        fail_weight[at] = np.log10(s / (counts[k - 1][known] + s))
        if k > 1:
            fails[at] = state[k - 2][grams[k - 2].place[grams[k - 1].example[known]]]
    first = np.cumsum([0, *(len(g.prints) for g in grams[:-1])])
    seen = np.concatenate([np.ones(len(counts[0]), bool), *(c > 0 for c in counts[1:])])
    return Automaton(first, seen, np.concatenate(weight), np.concatenate(leads), depth, fails, fail_weight)


def walk(automaton: Automaton, places: np.ndarray, bounds: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The log10 probability of each text, from left to right; ``places`` has the n-grams of each length that end at each token."""
    order = len(places)
    pieces = -(-np.diff(bounds) // segment)
    text = np.repeat(np.arange(len(pieces)), pieces)
    begin = bounds[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * segment
    end = np.minimum(begin + segment, bounds[1:][text])
    # the longest state that a segment can begin in was read in the order - 1 tokens before it
    low = np.maximum(begin - (order - 1), bounds[:-1][text])
    by = np.argsort(low - end, kind="stable")  # longest first, so that those still walking lie together
    low, begin, long_ = low[by], begin[by], (end - low)[by]
    state, score = np.zeros(len(by), np.int32), np.zeros(len(by))
    for t in range(int(long_[0]) if len(by) else 0):
        n = int(np.searchsorted(-long_, -t))  # segments of more than t tokens
        state[:n], log = automaton.step(state[:n], places[:, low[:n] + t])
        score[:n] += np.where(low[:n] + t >= begin[:n], log, 0.0)
    out = np.empty(len(by))
    out[by] = score
    return np.add.reduceat(out, np.cumsum(pieces) - pieces)


def _scorer(order: int, strengths: tuple[float, ...], total: int, vocabulary: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        f, bounds = _tokens(_texts(docs.column("text")))
        own = pa.array(np.argsort(answers.column("part").to_numpy()))
        one, more = (np.concatenate([_unplanes(x, 8, np.uint64) for x in answers.column(c).take(own).to_pylist()]).astype(np.int64) for c in ("c1", "ck"))
        grams = _grams(f, bounds, order)
        length = _longer(grams)[1]
        counts = [one, *(more[length == k] for k in range(1, order))]
        scores = walk(build(grams, counts, strengths, total, vocabulary), np.stack([g.place for g in grams]), bounds)
        seen, at = one[grams[0].place], bounds[:-1]
        return pa.table(
            {
                "row": docs.column("row"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(np.diff(bounds)),
                "n_known": pa.array(np.add.reduceat(seen > 0, at, dtype=np.int64)),
                "train_tokens": pa.array(np.full(len(at), total)),
                "base_score": pa.array(np.add.reduceat(np.log10((seen + 0.5) / (total + 0.5 * (vocabulary + 1))), at)),
                "score": pa.array(scores),
            }
        )

    return score


def lm_scores(docs: DataFrame, order: int = 3, strengths: tuple[float, ...] = (300.0, 3.0), folds: int = 5, fold: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with held_out, n_tokens, n_known, train_tokens, base_score and score.

    Documents with crc32(key) mod ``folds`` = ``fold`` are held out of the model.  ``strengths`` has that of the prior for
    each order from 2 on.
    """
    bits = (shares(docs, 6, ROW) - 1).bit_length()
    blocks = shares(docs, 4, ROW)
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = [x for x in docs.columns if x not in (text, *added)]
    held = F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds == fold, F.lit(False))
    # a row that is repeated very often is dealt to as many blocks as tasks read it
    block = F.pmod(F.xxhash64(F.lit(3), F.col(f"`{key}`"), text_hash(text), scan_number(docs)), F.lit(blocks)).cast("int")
    whole = docs.select(F.struct(*(F.col(f"`{x}`") for x in rest)).alias("row"), held.alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), block.alias("block"))
    dealt = whole.mapInArrow(_squeeze, T.StructType([*whole.schema.fields[:2], T.StructField("text", T.BinaryType()), whole.schema.fields[3]]))
    dealt = spread(dealt, 32, docs, "block")
    asked = dealt.groupBy("block").applyInArrow(_asker(order, bits), "block int, part int, h1 binary, n1 binary, hk binary, nk binary")
    answers = stored(spread(asked, 16, docs, "part").groupBy("part").applyInArrow(_answer, ANSWERS), "answers")
    total, vocabulary = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    row = dealt.schema["row"].dataType.simpleString()
    out = dealt.groupBy("block").cogroup(spread(answers.select("block", "part", "c1", "ck"), 32, docs, "block").groupBy("block")).applyInArrow(
        _scorer(order, tuple(strengths), total, vocabulary),
        f"row {row}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return out.select("row.*", *added)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def brute_force(docs: list[tuple[int | None, str | None]], order: int = 3, strengths: tuple[float, ...] = (300.0, 3.0)) -> list[tuple]:
    """The automaton as dictionaries, walked token by token, for small inputs."""
    split_ = {x: bytes(LOWER[np.frombuffer((t or "").encode(), np.uint8)]).split() + [None] for x, t in docs}
    out_of = {x: x is not None and zlib.crc32(str(x).encode()) % 5 == 1 for x in split_}
    count: Counter = Counter()
    for x, w in split_.items():
        if not out_of[x]:
            count.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    n = sum(c for g, c in count.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in count)

    def weight(state: tuple, token: object) -> float:
        if not state:
            return (count[(token,)] + 0.5) / (n + 0.5 * (v + 1))
        s = strengths[len(state) - 1]
        return (count[(*state, token)] + s * weight(state[1:], token)) / (count[state] + s)

    out = []
    for x, w in split_.items():
        state, score, base = (), 0.0, 0.0
        for token in w:
            while state and not count[state]:
                state = state[1:]
            score += math.log10(weight(state, token))
            base += math.log10(weight((), token))
            state = (*state, token)[-(order - 1) :]
        out.append((x, out_of[x], len(w), sum(count[(t,)] > 0 for t in w), n, base, score))
    return out
