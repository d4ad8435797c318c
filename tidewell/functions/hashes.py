"""FNV-1a as Arrow UDFs (its wrap-around products have no ANSI form), and the row hashes built on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# The FNV parameters, the sketch's seeds.
BASIS32, PRIME32 = 2166136261, 16777619
BASIS64, PRIME64 = 0xCBF29CE484222325, 0x100000001B3
SEED, SEED_STEP = 0x9E3779B9, 0x85EBCA6B


def _fnv(items: list[bytes], basis: int, prime: int, dtype) -> np.ndarray:
    """All items at once, a byte position at a time; sorted by size, so that those with a byte there come last."""
    size = np.array([len(b) for b in items], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    joined = np.frombuffer(b"".join(items), dtype=np.uint8)
    start = (np.cumsum(size) - size)[order]
    first = np.searchsorted(size[order], np.arange(int(size.max()) if len(items) else 0), side="right")
    found = np.full(len(items), basis, dtype=dtype)
    for k, live in enumerate(first.tolist()):
        found[live:] = (found[live:] ^ joined[start[live:] + k]) * dtype(prime)
    out = np.empty_like(found)
    out[order] = found
    return out


def fnv32(items: list[bytes]) -> np.ndarray:
    return _fnv(items, BASIS32, PRIME32, np.uint32)


def fnv64(items: list[bytes], most: int | None = 256) -> np.ndarray:
    """Of the first `most` bytes."""
    return _fnv([b[:most] for b in items], BASIS64, PRIME64, np.uint64)


def fnv1a32(text: Column) -> Column:
    @pandas_udf("bigint")
    def digest(text: pd.Series) -> pd.Series:
        return pd.Series(fnv32([t.encode() for t in text.fillna("")]).astype(np.int64))

    return digest(text)


def fnv1a64(text: Column, whole: bool = False) -> Column:
    """As a signed long; of the first 256 bytes, or of the whole text."""
    most = None if whole else 256

    @pandas_udf("bigint")
    def digest(text: pd.Series) -> pd.Series:
        return pd.Series(fnv64([t.encode() for t in text.fillna("")], most).view(np.int64))

    return digest(text)


def seeds(depth: int) -> list[int]:
    return [(SEED + k * SEED_STEP) & 0xFFFFFFFF for k in range(depth)]


def sketch_buckets(key: Column, width: int, depth: int) -> Column:
    """array<int>: the bucket of a key in each row of the sketch."""

    @pandas_udf("array<int>")
    def buckets(text: pd.Series) -> pd.Series:
        rows = [t.encode() for t in text.fillna("")]
        found = np.stack([fnv32([s.to_bytes(4, "little") + r for r in rows]) % np.uint32(width) for s in seeds(depth)], axis=1) if rows else np.zeros((0, depth))
        return pd.Series(list(found.astype(np.int32)))

    return buckets(key)
