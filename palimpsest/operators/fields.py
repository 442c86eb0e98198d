"""Row filters, splits and small derived tables over item fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as X

# Year ranges, bucket names and the shortest text kept for training.
FORTIES = (1940, 1950)
FORTIES_STRICT = (1941, 1950)
BUCKETS = ("empty", "1-5", "6-20", "over_20")
MIN_TRAINABLE = 30
EDITION_FIXUPS = [("^1022 W", "1022½ W")]


def filter_years(df: DataFrame, lo: int, hi: int, col: str = "year") -> DataFrame:
    """Rows with a year in ``[lo, hi]``; rows without one drop out."""
    return df.where(X.year_number(F.col(col)).between(lo, hi))


def drop_null_keys(df: DataFrame, key: str) -> DataFrame:
    return df.na.drop(subset=[key]).withColumn(key, F.col(key).cast("bigint"))


def with_bucket(df: DataFrame, col: str, name: str = "bucket") -> DataFrame:
    return df.withColumn(name, X.length_bucket(F.col(col)))


def split_by_bucket(df: DataFrame, col: str) -> dict[str, DataFrame]:
    """One lazily filtered table per length bucket."""
    bucket = X.length_bucket(F.col(col))
    return {b: df.where(bucket == b) for b in BUCKETS}


def write_by_bucket(df: DataFrame, col: str, path: str, mode: str = "errorifexists") -> None:
    """One folder per length bucket, so that readers of a bucket skip the others."""
    with_bucket(df, col).write.mode(mode).partitionBy("bucket").parquet(path)


def bucket_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``write_by_bucket``, each read from its own folder alone."""
    written = spark.read.parquet(path)
    return {b: written.where(F.col("bucket") == b) for b in BUCKETS}


def bucket_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows of each length bucket, those without rows included, from one aggregate."""
    bucket = X.length_bucket(F.col(col))
    counts = df.agg(*(F.count_if(bucket == b).alias(b) for b in BUCKETS))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(f"`{b}`").alias("row_count")) for b in BUCKETS))))


def split_by_flag(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """(rows without the flag, rows with it)."""
    return df.where(~F.col(flag)), df.where(F.col(flag))


def filter_trainable(
    df: DataFrame, title: str = "title", text: str = "transcript", min_len: int = MIN_TRAINABLE
) -> DataFrame:
    return df.where(
        F.col(title).isNotNull()
        & F.col(text).isNotNull()
        & (F.length(title) > 0)
        & (F.length(text) >= min_len)
    )


def to_text(df: DataFrame, col: str, keep_blank: bool = False) -> DataFrame:
    """Training text as ``text``; blank rows go, or only null ones with ``keep_blank``."""
    cond = F.col(col).isNotNull() if keep_blank else ~X.is_blank(F.col(col))
    return df.where(cond).select(F.col(col).alias("text"))


def apply_fixups(
    df: DataFrame, col: str, rules: Iterable[tuple[str, str]] = EDITION_FIXUPS
) -> DataFrame:
    return df.withColumn(col, X.apply_rules(F.col(col), rules))


def example_rows(
    df: DataFrame, flag: str, seq: str, text: str, n: int, order_by: str
) -> DataFrame:
    """First ``n`` flagged rows: sequence count, sequences and a 100-character preview."""
    return (
        df.where(F.col(flag))
        .orderBy(order_by)
        .limit(n)
        .select(
            order_by,
            F.size(seq).alias("sequence_count"),
            F.col(seq).alias("sequences"),
            F.concat(F.substring(text, 1, 100), F.lit("...")).alias("preview"),
        )
    )


def all_null_rows(df: DataFrame) -> DataFrame:
    cond: Column = F.lit(True)
    for c in df.columns:
        cond = cond & F.col(f"`{c}`").isNull()
    return df.where(cond)
