"""Reproducible draws: a hash of (seed, task, key) instead of a random generator.

The same row always gets the same draw, whatever the partitioning or retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 2**32


def hash32(seed: int, task: str, key: Column) -> Column:
    """Whole number in ``[0, 2**32)`` from the first eight hex digits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{task}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(lo: float, hi: float, seed: int, task: str, key: Column) -> Column:
    return F.lit(lo) + F.lit(hi - lo) * (hash32(seed, task, key) / F.lit(float(HASH_RANGE)))


def uniform_int(lo: Column, hi: Column, seed: int, task: str, key: Column) -> Column:
    """Whole number in ``[lo, hi]``, both ends included."""
    width = (hi - lo + 1).cast("bigint")
    return (lo + F.shiftright(hash32(seed, task, key) * width, 32)).cast("int")


def split_ratios(key: Column, seed: int = 0) -> Column:
    """``struct<beginning, middle_gap, end_start, mid_split>`` for a three-way split."""
    beginning = uniform(0.15, 0.25, seed, "beginning", key)
    gap = uniform(0.30, 0.50, seed, "middle_gap", key)
    buffer = uniform(0.05, 0.15, seed, "buffer", key)
    return F.struct(
        beginning.alias("beginning"),
        gap.alias("middle_gap"),
        (beginning + gap + buffer).alias("end_start"),
        uniform(0.4, 0.7, seed, "mid_split", key).alias("mid_split"),
    )
