"""Artifact flags per row and the aggregates behind the messiness reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import patterns as P
from palimpsest.functions import text as X
from palimpsest.functions.rounding import round_ratio
from palimpsest.sources.tables import write_observed

# Issue names in report order, and item types counted by name.
ISSUE_SPECIAL = "Special Char Artifacts"
ISSUE_GENERAL = "General Artifacts"
ISSUE_REPEAT = "Repeat Chars"
ISSUE_EMPTY = "Empty Transcript"
ISSUE_SHORT = "Low Char Count"
ITEM_TYPES = {
    "still_image": "still image",
    "text": "text",
    "still_image_text": "still image; text",
}

MESSY_FLAGS = ("has_messy", "has_special_messy", "has_repeat_sequence")


def pattern_flags(df: DataFrame, col: str) -> DataFrame:
    """The three artifact flags alone.

    Searching stops at the first hit; a repeated letter always lies in a word, so the
    short pattern decides the third flag.
    """
    text = F.coalesce(F.col(col), F.lit(""))
    return df.withColumns(
        {
            "special_pattern": text.rlike(P.SPECIAL),
            "general_pattern": F.size(X.general_sequences(text)) > 0,
            "repeat_chars": text.rlike(P.REPEAT_HINT),
        }
    )


def profile(df: DataFrame, col: str = "original_transcript") -> DataFrame:
    """Length, flags, overall quality, issue names and artifacts of each row.

    Every pattern runs once: the match arrays are columns of a first projection and all
    flags are read off them.
    """
    found = df.withColumns(
        {
            "_special": X.special_sequences(F.col(col)),
            "_general": X.general_sequences(F.col(col)),
            "_repeat": X.repeat_letters(F.col(col)),
            "original_len": X.char_len_nospace(F.coalesce(F.col(col), F.lit(""))),
        }
    )
    special, general, repeat = (F.size(c) > 0 for c in ("_special", "_general", "_repeat"))
    short = F.col("original_len") < X.SHORT_LENGTH
    issues = F.array_compact(
        F.array(
            F.when(special, ISSUE_SPECIAL),
            F.when(general, ISSUE_GENERAL),
            F.when(repeat, ISSUE_REPEAT),
            F.when(F.col("original_len") == 0, ISSUE_EMPTY).when(short, ISSUE_SHORT),
        )
    )
    return found.withColumns(
        {
            "special_pattern": special,
            "general_pattern": general,
            "repeat_chars": repeat,
            "short_transcript": short,
            "quality": ~(special | general | repeat | short),
            "issue_types": issues,
            "detected_artifacts": F.concat("_special", "_general", "_repeat"),
        }
    ).drop("_special", "_general", "_repeat")


def messy_columns(df: DataFrame, col: str = "transcript") -> DataFrame:
    """Match arrays with counts, flags and matched characters, and ``any_messy``."""
    found = df.withColumns(
        {
            "messy_sequences": X.general_sequences(F.col(col)),
            "special_messy_sequences": X.special_sequences(F.col(col)),
            "repeat_sequences": X.repeat_letters(F.col(col)),
        }
    )

    def chars(c: str) -> Column:
        return F.length(F.array_join(c, ""))

    general, special, repeat = (
        F.size(c) for c in ("messy_sequences", "special_messy_sequences", "repeat_sequences")
    )
    return found.withColumns(
        {
            "messy_count": general,
            "has_messy": general > 0,
            "total_messy_chars": chars("messy_sequences"),
            "special_messy_count": special,
            "has_special_messy": special > 0,
            "total_special_messy_chars": chars("special_messy_sequences"),
            "repeat_sequence_count": repeat,
            "has_repeat_sequence": repeat > 0,
            "any_messy": (general > 0) | (special > 0) | (repeat > 0),
        }
    )


def _long(df: DataFrame, rows: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into rows of a small table."""
    return df.select(F.inline(F.array(*rows)))


def messy_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, flagged rows with their percentage, and sequence totals, per group."""
    total = F.count(F.lit(1))
    aggs = [total.alias("total_rows")]
    for name, flag in zip(("messy", "special_messy", "repeat"), MESSY_FLAGS):
        hits = F.count_if(F.col(flag))
        aggs += [hits.alias(f"{name}_rows"), round_ratio(hits, total, 1, 100).alias(f"{name}_percent")]
    aggs += [
        F.coalesce(F.sum("messy_count"), F.lit(0)).alias("messy_sequences_total"),
        F.coalesce(F.sum("special_messy_count"), F.lit(0)).alias("special_messy_sequences_total"),
        F.coalesce(F.sum("repeat_sequence_count"), F.lit(0)).alias("repeat_sequences_total"),
    ]
    return df.groupBy(*by).agg(*aggs)


def top_sequences(df: DataFrame, col: str, n: int = 50) -> DataFrame:
    """Most frequent elements of an array column; equal counts in lexical order."""
    return (
        df.select(F.explode(col).alias("sequence"))
        .groupBy("sequence")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), F.asc("sequence"))
        .limit(n)
    )


def flag_breakdown(df: DataFrame) -> DataFrame:
    """Messy and clean rows per flag, and for any flag at all."""
    flags = (*MESSY_FLAGS, "any_messy")
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f)).alias(f) for f in flags]
    )
    return _long(
        counts,
        [
            F.struct(
                F.lit(f).alias("flag"),
                F.col(f).alias("messy_rows"),
                (F.col("_rows") - F.col(f)).alias("clean_rows"),
            )
            for f in flags
        ],
    )


def flag_overlap(df: DataFrame) -> DataFrame:
    """Rows with exactly one kind of artifact, per kind, and with more than one."""
    kinds = dict(zip(("General Only", "Special Only", "Repeat Only"), MESSY_FLAGS))
    hits = sum((F.col(f).cast("int") for f in MESSY_FLAGS), F.lit(0))
    counts = df.agg(
        *[F.count_if((hits == 1) & F.col(f)).alias(k) for k, f in kinds.items()],
        F.count_if(hits > 1).alias("Multi-Type"),
    )
    return _long(
        counts,
        [
            F.struct(F.lit(k).alias("overlap"), F.col(k).alias("row_count"))
            for k in (*kinds, "Multi-Type")
        ],
    )


def summary_table(df: DataFrame, flag: str = "has_messy") -> DataFrame:
    """``(metric, value)`` rows for a report sheet, values as text."""
    return _summary_rows(df.agg(*(c.alias(k) for k, c in summary_metrics(flag).items())))


def summary_metrics(flag: str = "has_messy") -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "m": F.count_if(F.col(flag))}


def _summary_rows(counts: DataFrame) -> DataFrame:
    percent = F.coalesce(round_ratio(F.col("m"), F.col("n"), 1, 100), F.lit(0.0))
    values = {
        "Total Rows": F.col("n").cast("string"),
        "Messy Rows": F.col("m").cast("string"),
        "Clean Rows": (F.col("n") - F.col("m")).cast("string"),
        "Percent Messy": F.concat(F.format_string("%.1f", percent), F.lit("%")),
    }
    return _long(
        counts, [F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()]
    )


def write_report(details: DataFrame, folder: str, flag: str = "has_messy", mode: str = "errorifexists") -> None:
    """Tables ``metadata`` (the details) and ``summary`` under ``folder``, the details worked out once.

    The summary's counts are gathered while the details are written.
    """
    counts = write_observed(details, f"{folder}/metadata", summary_metrics(flag), mode)
    row = details.sparkSession.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in counts.items()))
    _summary_rows(row).write.mode(mode).parquet(f"{folder}/summary")


def type_counts(df: DataFrame, col: str = "type", by: Sequence[str] = ()) -> DataFrame:
    """Rows per item type, compared in lower case; everything else, null included, is other."""
    kind = F.coalesce(F.lower(F.col(col)), F.lit(""))
    named = kind.isin(*ITEM_TYPES.values())
    return df.groupBy(*by).agg(
        *[F.count_if(kind == v).alias(k) for k, v in ITEM_TYPES.items()],
        F.count_if(~named).alias("other"),
        F.count(F.lit(1)).alias("total"),
    )


def empty_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null or blank records per column, all columns in one pass."""
    counts = df.agg(*[F.count_if(X.is_blank(F.col(c).cast("string"))).alias(c) for c in cols])
    return _long(
        counts,
        [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("empty_records")) for c in cols],
    )


def quality_counts(df: DataFrame, flag: str = "quality_transcript") -> DataFrame:
    passed = F.coalesce(F.col(flag), F.lit(False))
    return df.agg(F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"))
