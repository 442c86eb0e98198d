"""Metadata to semi-clean transcripts: one narrow stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.clean import semi_clean
from palimpsest.operators.profile import profile


def add_fields(df: DataFrame, date: str | None = "date", text: str = "transcript", year_mode: str = "digits") -> DataFrame:
    """Add ``year`` and turn the raw transcript into ``original_transcript``."""
    if date:
        df = df.withColumn("year", X.extract_year(F.col(date), year_mode))
    return df.withColumn("original_transcript", X.normalize_blank(F.col(text))).drop(text)


def clean_items(df: DataFrame, date: str | None = "date", text: str = "transcript", repeat_mode: str = "collapse") -> DataFrame:
    """Fields, profile and semi-clean transcript.  Also runs on a streaming table."""
    return semi_clean(profile(add_fields(df, date, text)), repeat_mode=repeat_mode)
