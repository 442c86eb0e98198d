"""Row numbers.  A DataFrame has no order of its own, so numbers are made once and kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import shared_dir

PARTITION_BITS = 33
#: Files up to which their offsets (a path and a number each) are broadcast.
BROADCAST_FILES = 20_000


def with_file_row_no(scan: DataFrame, start: int = 2, name: str = "row_no") -> DataFrame:
    """Number the rows of a Parquet scan by file path and place in the file, from ``start`` without gaps.

    The number of a row depends on the files alone: nothing is sorted, checkpointed or kept, a
    retried task gives the same numbers, and so does a later read of the same files.  Rows must
    be numbered before they are filtered, on the scan itself.  Only the counts per file
    are added up; they are broadcast up to ``BROADCAST_FILES`` files and joined otherwise.
    """
    placed = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    sizes = placed.groupBy("_file").agg((F.max("_place") + 1).alias("_n"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    if len(scan.inputFiles()) <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, "_file").select(*scan.columns, (F.col("_before") + F.col("_place") + start).alias(name))


def with_row_no(
    df: DataFrame, order_by: list[str] | None = None, start: int = 2, name: str = "row_no"
) -> DataFrame:
    """Number rows from ``start`` without gaps (2 is the spreadsheet row under a header).

    With ``order_by`` those columns alone are range-sorted, placed and checkpointed, and the rows
    get their numbers by a join on them; nulls are keys like others.  Where they do not
    identify a row, whole rows are sorted and checkpointed instead, and ties come in any order.
    Without ``order_by`` the scan order counts (``with_file_row_no`` needs no checkpoint).

    No task ever holds more than one partition: each row gets a place inside its partition, and
    only the per-partition counts are summed up.  Places are checkpointed, so a lost
    executor cannot change them.
    """
    if not order_by:
        return _placed(df, start, name)
    keys = _placed(df.select(*order_by).orderBy(*order_by), start, name)
    if set(df.columns) <= set(order_by):
        return keys.select(*df.columns, name)
    if not keys.groupBy(*order_by).count().where("count > 1").isEmpty():
        return _placed(df.orderBy(*order_by), start, name)
    named = keys.select(name, *(F.col(c).alias(f"_key_{i}") for i, c in enumerate(order_by)))
    return df.join(named, _same(order_by)).select(*df.columns, name)


def _same(order_by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(order_by)))


def _placed(df: DataFrame, start: int, name: str) -> DataFrame:
    """Rows numbered in the order of their partitions; the numbered rows are checkpointed."""
    shared_dir(df.sparkSession)
    placed = df.withColumn("_place", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_place", PARTITION_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row of two numbers per partition: bounded by the partition count, not the data.
    offsets = F.broadcast(
        counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    within = F.col("_place").bitwiseAND(F.lit(2**PARTITION_BITS - 1))
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, F.col("_before") + within + start)
        .drop("_part", "_place", "_before")
    )


def zip_rows(a: DataFrame, b: DataFrame, on: str = "row_no", how: str = "full") -> DataFrame:
    """Put two numbered tables side by side by row number."""
    shared = (set(a.columns) & set(b.columns)) - {on}
    if shared:
        raise ValueError(f"rename columns present on both sides first: {sorted(shared)}")
    return a.join(b, on, how)
