"""Distinct words of a batch, and putting their encodings back in place of every word."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa


def distinct(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """(index of each word, distinct words)."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def flatten(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, all values) of lists of small integers."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return lengths, np.fromiter(chain.from_iterable(lists), np.int64, int(lengths.sum()))


def spread(index: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists picked by index, one after another: (length of each, values of all)."""
    per = lengths[index]
    ends = np.cumsum(per)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    shift = ((np.cumsum(lengths) - lengths)[index] - (ends - per)).astype(kind)
    at = np.repeat(shift, per)
    at += np.arange(total, dtype=kind)
    return per, values[at]


def per_document(per_word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of per_word over the word ranges bounds[i]:bounds[i + 1]."""
    sums = np.concatenate([[0], np.cumsum(per_word)])
    return sums[bounds[1:]] - sums[bounds[:-1]]
