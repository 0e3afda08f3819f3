"""Deterministic draws: the same integer on every engine that has SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32


def key(seed: str, *parts: Column) -> Column:
    return F.concat_ws("-", F.lit(seed), *[p.cast("string") for p in parts])


def draw32(seed: str, *parts: Column) -> Column:
    """Integer in [0, 2^32): the first 8 hex digits of SHA-256(seed-part-part...)."""
    return F.conv(F.substring(F.sha2(key(seed, *parts), 256), 1, 8), 16, 10).cast("bigint")


def uniform(seed: str, *parts: Column) -> Column:
    """Double in [0, 1)."""
    return draw32(seed, *parts) / F.lit(float(RANGE))
