"""Table-level sinks, subset projections and column checks."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require_columns(df: DataFrame, cols: Iterable[str], on_missing: str = "raise") -> list[str]:
    """Columns of ``cols`` that ``df`` lacks; raises (or warns) when there are any."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        message = f"missing columns {missing}; available: {df.columns}"
        if on_missing == "raise":
            raise ValueError(message)
        warnings.warn(message, stacklevel=2)
    return missing


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of ``b`` that ``a`` lacks, with their types.  Schema only, no data is read."""
    rows = [(f.name, f.dataType.simpleString()) for f in b.schema if f.name not in a.columns]
    return b.sparkSession.createDataFrame(rows, "column_name string, column_type string")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, UTF-8, characters unescaped; null fields are left out."""
    df.write.mode(mode).json(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One Parquet table per name under ``folder``."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def write_observed(df: DataFrame, path: str, metrics: Mapping[str, Column], mode: str = "errorifexists") -> dict[str, object]:
    """Write one Parquet table and return aggregates of the rows, gathered while they are written."""
    seen = Observation(f"written {uuid.uuid4().hex}")
    df.observe(seen, *(c.alias(k) for k, c in metrics.items())).write.mode(mode).parquet(path)
    return seen.get


def variant_tables(
    df: DataFrame, variants: Mapping[str, str], name: str = "transcript"
) -> dict[str, DataFrame]:
    """One projection per transcript variant, plus ``all`` with every variant.

    ``variants`` maps a table name to its transcript column, renamed to ``name``.
    """
    require_columns(df, variants.values())
    base = [c for c in df.columns if c not in set(variants.values())]
    tables = {k: df.select(*base, F.col(c).alias(name)) for k, c in variants.items()}
    return {"all": df.select(*base, *variants.values()), **tables}


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
