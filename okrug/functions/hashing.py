"""The public XXH64 hash of 64-bit integers over numpy arrays, equal to Spark's xxhash64 of BIGINT columns."""

from __future__ import annotations

import numpy as np

# The primes of XXH64 and Spark's seed.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = np.uint64(42)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """int64 hashes of int64 columns (or scalars), the same as F.xxhash64 gives for BIGINT columns."""
    h = SEED
    with np.errstate(over="ignore"):
        for column in columns:
            v = np.asarray(column, dtype=np.int64).view(np.uint64)
            h = (h + P5 + np.uint64(8)) ^ (_turn(v * P2, 31) * P1)
            h = _turn(h, 27) * P1 + P4
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            h = h ^ (h >> np.uint64(32))
    return np.asarray(h).view(np.int64)
