"""Hashed sparse text features of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textcode as tc

#: Byte lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5)
#: Hashed feature space: 2**BITS weights.
BITS = 20


def sparse(column: pa.Array, prefixes: tuple[int, ...] = PREFIXES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value, words per row) of a string array.

    Features are whole words and word beginnings, hashed; values are 1 + ln(count),
    scaled so that each row has Euclidean length 1.
    """
    words = tc.Words(column)
    n = len(words)
    sizes = np.diff(words.off)
    rows = np.repeat(np.arange(n), sizes)
    shift = np.uint64(64 - bits)
    row_parts, feature_parts = [rows], [words.hash >> shift]
    for p in prefixes:
        at = np.flatnonzero(words.end - words.start > p)
        row_parts.append(rows[at])
        feature_parts.append(words.prefix(at, p) >> shift)
    code = (np.concatenate(row_parts).astype(np.int64) << bits) | np.concatenate(feature_parts).astype(np.int64)
    code, counts = np.unique(code, return_counts=True)
    row, feature = code >> bits, (code & ((1 << bits) - 1)).astype(np.int32)
    value = (1 + np.log(counts)).astype(np.float32)
    norm = np.sqrt(np.bincount(row, value.astype(np.float64) ** 2, minlength=n))
    return row, feature, value / np.maximum(norm, 1e-9)[row].astype(np.float32), sizes
