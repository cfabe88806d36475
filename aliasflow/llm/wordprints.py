"""Vectorised word splitting and Rabin-Karp fingerprints over Arrow string columns.

A batch of texts is handled as one byte buffer.  A polynomial hash over the bytes, modulo 2**64, gives every word
a 64-bit fingerprint without making a Python object for it, and a second polynomial over the words gives every run of
``k`` words one.  Both are finished with a mixing step that also takes the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes 0x20 and 0x09-0x0D separate words.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1, 2**63, dtype=np.uint64)) * 2 + 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ U(salt)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as longer inputs come."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = U(base), U(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


class Hasher:
    """Fingerprints of words and of runs of words; hashers of different seeds are independent."""

    def __init__(self, seed: int) -> None:
        self.table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
        self.bytes, self.words, self.salt = Powers(_odd(seed + 1)), Powers(_odd(seed + 2)), _odd(seed + 3)

    def of_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = self.bytes.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(self.table[data] * up[:-1], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start], self.salt) + (end - start).astype(U)

    def of_runs(self, words: np.ndarray, first: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Of the runs that begin at ``first`` and are ``length`` words long."""
        up, down = self.words.upto(len(words) + 1)
        sums = np.zeros(len(words) + 1, U)
        np.cumsum(words * up[:-1], out=sums[1:])
        return mix((sums[first + length] - sums[first]) * down[first], self.salt) + np.asarray(length).astype(U)


@dataclass
class Words:
    """The words of a run of texts: byte ranges, and for each text the range of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every run of k words inside one text, and the text."""
        n = np.maximum(self.counts() - k + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        begin = np.concatenate([[0], np.cumsum(n)])[:-1]
        return np.arange(n.sum()) - begin[text] + self.bounds[:-1][text], text


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; a null counts as an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split(raw: np.ndarray, at: np.ndarray, spaces: np.ndarray = ASCII_SPACE, case: np.ndarray = SAME) -> Words:
    """Words of the texts that lie at ``at``: maximal runs of bytes that are no separators."""
    data = raw if case is SAME else case[raw]
    inside = ~spaces[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = at[1:-1]
    edges = edges[edges < len(data)]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def pieces(at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, or of one text that is longer."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, high
        low = high


def each(texts: pa.Array, spaces: np.ndarray = ASCII_SPACE, case: np.ndarray = SAME, most: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """The words of a column, in pieces that bound memory: first text, end, and their words."""
    raw, at = buffers(texts)
    for low, high in pieces(at, most):
        yield low, high, split(raw[at[low] : at[high]], at[low : high + 1] - at[low], spaces, case)
