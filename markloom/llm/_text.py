"""Vectorised words, word hashes and word n-grams over Arrow string batches.

A word is a run of bytes outside space and 0x09-0x0D. Words are hashed by a polynomial
over random byte weights, modulo 2**64, then mixed; all steps are numpy over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes and documents handled at once: numpy temporaries are about 60 times the bytes.
CHUNK_BYTES = 1 << 18
CHUNK_ROWS = 2048

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_GRAM = U(0xD6E8FEB86659FD93)
_WEIGHTS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[U, np.ndarray] = {}


def _power(base: U, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept between calls."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(n + n // 2 + 1, base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of consecutive documents. ``first[i]:first[i + 1]`` are those of document i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, salt: int = 0) -> np.ndarray:
        """Hashes of all words; another salt means other byte weights."""
        n = len(self.data)
        weights = mix(_WEIGHTS + U(salt)) | U(1) if salt else _WEIGHTS
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(weights[self.data] * _power(_BASE, n), out=sums[1:], dtype=np.uint64)
        h = (sums[self.ends] - sums[self.starts]) * _power(_INVERSE, n + 1)[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))

    def room(self) -> np.ndarray:
        """For each word, the words from it to its document's end."""
        per = np.diff(self.first)
        return np.repeat(self.first[1:], per) - np.arange(len(self.starts))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """data: bytes of consecutive documents; offsets: n + 1 document bounds, from 0."""
    word = ~_BLANK[data]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    if len(data):
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        ends = offsets[1:]
        after[ends[ends > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    return Words(data, starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; the last k - 1 entries are meaningless."""
    out = np.zeros(len(h), np.uint64)
    n = len(h) - k + 1
    if n > 0:
        g = h[:n].copy()
        for j in range(1, k):
            g *= _GRAM
            g += h[j : n + j]
        out[:n] = mix(g)
    return out


def chunks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, Words) for pieces of about CHUNK_BYTES; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, min(a + CHUNK_ROWS, int(np.searchsorted(bounds, bounds[a] + CHUNK_BYTES, side="right")) - 1))
        part = data[bounds[a] : bounds[b]]
        yield a, b, words_of(_LOWER[part] if lower else part, bounds[a : b + 1] - bounds[a])
        a = b
