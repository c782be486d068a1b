"""A portable source of randomness: the first 32 bits of an MD5 over a seed and a key. The same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(seed: int | str, *keys: Column) -> Column:
    """0 .. 2^32 - 1 as BIGINT."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))), 1, 8), 16, 10).cast("bigint")


def between(seed: int | str, low: Column, high: Column, *keys: Column) -> Column:
    """An integer from low to high, both included."""
    return low + hashed(seed, *keys) % (high - low + 1)
