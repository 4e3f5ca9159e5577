"""Hashes of words as numpy arrays, for the operators that work on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """64-bit hash of a word (bytes or text), computed once."""

    def __missing__(self, word: bytes | str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * GOLDEN
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of longs; ``ends`` begins with 0."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))
