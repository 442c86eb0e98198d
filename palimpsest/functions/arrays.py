"""Array helpers that stay inside the JVM and run in linear or n·log n time per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Without this, an expression captured by a lambda is evaluated again per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indexes(n: Column) -> Column:
    """``[0, 1, ..., n-1]``, empty for ``n <= 0`` (plain ``sequence`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def runs(arr: Column) -> Column:
    """Distinct elements with their counts: ``array<struct<value, n>>`` in sorted order."""

    def from_sorted(s: Column) -> Column:
        starts = F.array_compact(
            F.transform(s, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(s, i - 1)), i))
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("value"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("n"),
                ),
            ),
        )

    return let(F.array_sort(arr), from_sorted)
