"""Composite cleaning of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X


def tidy(c: Column) -> Column:
    """Stray punctuation, unclosed parentheses and space runs, in that order."""
    return X.normalize_spaces(X.strip_unclosed_paren(X.strip_stray_punct(c)))


def semi_clean_text(c: Column, quality: Column, short: Column, repeat_mode: str = "collapse") -> Column:
    """Good texts pass, short ones become ``''``, the rest lose their artifacts; all are tidied."""
    body = (
        F.when(quality, c)
        .when(short, F.lit(""))
        .otherwise(X.remove_patterns(c, order="A", repeat_mode=repeat_mode))
    )
    return tidy(body)


def semi_clean(
    df: DataFrame,
    col: str = "original_transcript",
    out: str = "semi_clean_transcript",
    repeat_mode: str = "collapse",
) -> DataFrame:
    """Needs the ``quality`` and ``short_transcript`` columns of ``profile``."""
    return df.withColumn(
        out, semi_clean_text(F.col(col), F.col("quality"), F.col("short_transcript"), repeat_mode)
    )


def semi_clean_messy(
    df: DataFrame, col: str = "transcript", out: str = "semi_clean_transcript"
) -> DataFrame:
    """For rows already chosen as messy: removal in order B, no quality or length gate."""
    return df.withColumn(out, tidy(X.remove_patterns(F.col(col), order="B")))
