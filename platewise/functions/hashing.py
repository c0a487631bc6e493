"""Keys and pseudo-random numbers that do not depend on partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_key(seed: int | str, *cols: Column | str) -> Column:
    """Order key: md5 of seed and values joined by '|'."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def md5_int(key: Column) -> Column:
    """First 32 bits of a hex digest as BIGINT."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def md5_halves(key: Column) -> tuple[Column, Column]:
    """First 60 bits of a hex digest as two numbers of 32 and 28 bits."""
    return md5_int(key), F.conv(F.substring(key, 9, 7), 16, 10).cast("bigint")


def stable_id(prefix: str, *cols: Column) -> Column:
    """`prefix` plus 16 hex digits of sha256 over the values; NULL counts as 'NA'."""
    values = [F.coalesce(c.cast("string"), F.lit("NA")) for c in cols]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *values), 256), 1, 16))


def pair_id(prefix: str, a: Column, b: Column) -> Column:
    return stable_id(prefix, F.least(a, b), F.greatest(a, b))


def mix32(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 32-bit numbers held as unsigned 64-bit ones."""
    mask = np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & mask
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & mask
    return x ^ (x >> np.uint64(16))


def mix_narrow(x: np.ndarray) -> np.ndarray:
    """`mix32` of numbers held as 32-bit ones, whose products wrap by themselves."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x
