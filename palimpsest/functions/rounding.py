"""Ratios rounded the way the data was rounded: half-even on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.arrays import let

WIDE = "decimal(38,0)"


def round_ratio(num: Column, den: Column, digits: int, scale: int = 1) -> Column:
    """``round(scale * (num / den), digits)`` for whole numbers with a value under 128.

    Only when the true ratio lies exactly between two results does the stored double
    decide; it is compared with the midpoint in whole-number arithmetic.  Null for a
    zero or null ``den``.
    """
    unit = 10**digits

    # Both numbers are bound once: the steps below use them many times over.
    def rounded(pair: Column) -> Column:
        num, den = pair["num"], pair["den"]
        scaled = num * (unit * scale)
        rest = scaled % den
        low = ((scaled - rest) / den).cast("bigint")
        value = num / den * scale

        def beyond_midpoint(power: int) -> Column:
            stored = (value * float(power)).cast("bigint").cast(WIDE) * F.lit(2 * unit).cast("decimal(8,0)")
            midpoint = (2 * low + 1).cast(WIDE) * F.lit(str(power)).cast("decimal(21,0)")
            return (
                F.when(stored.cast(WIDE) > midpoint.cast(WIDE), 1)
                .when(stored.cast(WIDE) == midpoint.cast(WIDE), low % 2)
                .otherwise(0)
            )

        # A power of two that makes every bit of the double whole and still fits 63 bits.
        tie = F.when(value >= 0.125, beyond_midpoint(2**55)).otherwise(beyond_midpoint(2**63))
        step = F.when(2 * rest > den, 1).when(2 * rest < den, 0).otherwise(tie)
        return (low + step) / F.lit(float(unit))

    den = F.nullif(den.cast("bigint"), F.lit(0).cast("bigint"))
    return let(F.struct(num.cast("bigint").alias("num"), den.alias("den")), rounded)
