"""Words, hashes and Arrow columns shared by text operators."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: A word is a maximal run of letters and digits in the lower-case text.
WORD = re.compile(r"[^\W_]+")

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += GOLDEN
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)
