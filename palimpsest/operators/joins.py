"""Key lookups between item tables.

No side is ever forced to be broadcast: Spark measures sizes at run time, broadcasts a
side under its threshold and otherwise sort-merges with skewed partitions split.  Lookup
sides are reduced to distinct keys before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _same(df: DataFrame, key: str, other: str):
    return df[key].eqNullSafe(F.col(other))


def restrict_to(main: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    """Rows of ``main`` whose key occurs in ``subset``; a null key matches a null key."""
    keys = subset.select(F.col(key).alias("_key")).distinct()
    return main.join(keys, _same(main, key, "_key"), "left_semi")


def attach(main: DataFrame, right: DataFrame, key: str, cols: list[str], last_by: str | None = None) -> DataFrame:
    """Left join bringing ``cols`` across; null matches null.

    Repeated keys fan out: n rows of a key, null included, that meet m rows give n * m.  With
    ``last_by`` only the right row with the largest value of that column counts for each key,
    and every row of ``main`` stays one row.
    """
    lookup = right.select(F.col(key).alias("_key"), *cols)
    if last_by is not None:
        top = F.max_by(F.struct(*cols), F.col(last_by)).alias("_row")
        lookup = right.groupBy(F.col(key).alias("_key")).agg(top).select("_key", *(F.col("_row")[c].alias(c) for c in cols))
    return main.join(lookup, _same(main, key, "_key"), "left").drop("_key")


def override_values(
    main: DataFrame,
    manual: DataFrame,
    key: str,
    col: str,
    order_col: str,
    flag: str | None = "overridden",
) -> DataFrame:
    """Replace ``col`` by the manual value of the same key; the last duplicate wins.

    Manual rows with a null key or value are ignored.  ``flag`` marks replaced rows, so
    counting them is an aggregate over the result.  Rows of ``main`` with a null key go round
    the join, so that they do not meet in one task.
    """
    latest = (
        manual.where(F.col(key).isNotNull() & F.col(col).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(F.struct(F.col(order_col), F.col(col).alias("_value")))["_value"].alias("_manual"))
    )
    joined = main.where(main[key].isNotNull()).join(latest, main[key] == F.col("_key"), "left")
    joined = joined.unionByName(main.where(main[key].isNull()), allowMissingColumns=True)
    out = joined.withColumn(col, F.coalesce("_manual", col))
    if flag:
        out = out.withColumn(flag, F.col("_manual").isNotNull())
    return out.drop("_key", "_manual")


def missing_keys(manual: DataFrame, main: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of ``manual`` that ``main`` does not have."""
    wanted = manual.select(key).where(F.col(key).isNotNull()).distinct()
    return wanted.join(main.select(key).distinct(), key, "left_anti")


def updated_sample(
    main: DataFrame, manual: DataFrame, key: str, col: str, order_by: str, n: int = 3
) -> DataFrame:
    """First ``n`` rows of ``main`` whose key has a manual value, with a 100-character preview."""
    keys = manual.where(F.col(key).isNotNull() & F.col(col).isNotNull()).select(key).distinct()
    hits = main.join(keys, key, "left_semi")
    text = F.col(col)
    preview = F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 100), F.lit("..."))).otherwise(text)
    return hits.orderBy(order_by).limit(n).select(order_by, key, preview.alias("preview"))


def find_rows(
    subset: DataFrame, main: DataFrame, key: str, base: int = 2, row_no: str = "row_no"
) -> DataFrame:
    """Where the subset's keys stand in ``main``: key, 0-based index, row number from ``base``.

    ``main`` is numbered from 0 in ``row_no``; every duplicate is reported, nulls never match.
    """
    keys = subset.select(key).where(F.col(key).isNotNull()).distinct()
    return main.select(key, row_no).join(keys, key, "left_semi").select(
        key,
        F.col(row_no).alias("row_index"),
        (F.col(row_no) + base).alias("row_number"),
    )


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """All members of repeated keys, null included.

    Counted with map-side partial sums and joined back, so that one hot key is never a
    single task as it would be in a window over the key.
    """
    repeated = (
        df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ).select("_key")
    return df.join(repeated, _same(df, key, "_key"), "left_semi")


def count_distinct(df: DataFrame, key: str) -> DataFrame:
    """Number of distinct non-null keys, as a one-row table."""
    return df.agg(F.count_distinct(F.col(key)).alias("distinct_keys"))
