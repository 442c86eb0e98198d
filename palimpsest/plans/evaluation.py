"""Answers to scores to model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from palimpsest.operators.evaluate import mean_scores, score_rows


def accuracy(df: DataFrame, ids: Sequence[str] = ("question", "answer")) -> tuple[DataFrame, DataFrame]:
    """(row scores, means) of every response column against ``answer``."""
    rows = score_rows(df, ids, "answer")
    return rows, mean_scores(rows)


def consistency(df: DataFrame, ids: Sequence[str] = ("question", "answer", "response_1")) -> tuple[DataFrame, DataFrame]:
    """(row scores, means) of the later responses against ``response_1``."""
    rows = score_rows(df, ids, "response_1")
    return rows, mean_scores(rows)
