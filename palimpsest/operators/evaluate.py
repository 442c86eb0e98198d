"""Correction metrics and answer scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import patterns as P
from palimpsest.functions import scores as S
from palimpsest.functions.arrays import let
from palimpsest.sources.tables import require_columns

METRICS = ("bleu", "rouge_l", "jsd", "jaccard", "levenshtein")


def _distinct_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(P.WORD_RUN), F.lit(0)))


def _analyzed(original: Column, corrected: Column, own: Column) -> Column:
    """``analyze_corrections`` given the original's distinct words, a bound column.

    Equal texts have equal words, so only a text that was changed is searched for its own.
    """
    both = original.isNotNull() & corrected.isNotNull()
    none = F.array().cast("array<string>")
    same = original == corrected
    flagged = F.when(both & corrected.contains("["), F.regexp_count(corrected, F.lit(P.FLAGGED_WORDS))).otherwise(0)
    words = F.struct(
        F.when(both, own).otherwise(none).alias("a"),
        F.when(~both, none).when(same, own).otherwise(_distinct_words(corrected)).alias("b"),
        (both & same).alias("same"),
        flagged.alias("flagged"),
    )

    def counts(w: Column) -> Column:
        n = F.size(w["a"])
        return let(
            F.when(w["same"], 0).otherwise(F.size(F.array_except(w["b"], w["a"]))),
            lambda new: F.struct(
                n.alias("original_words"),
                F.size(w["b"]).alias("corrected_words"),
                new.alias("different_words"),
                F.when(n > 0, new / n * 100).otherwise(0.0).alias("percent_changed"),
                w["flagged"].alias("flagged_words"),
            ),
        )

    return let(words, counts)


def analyze_corrections(original: Column, corrected: Column) -> Column:
    """Struct of distinct-word counts, new words, their percentage and bracket flags.

    Zeros when either side is null.
    """
    return let(_distinct_words(original), lambda own: _analyzed(original, corrected, own))


def correction_metrics(
    df: DataFrame, original_cols: Sequence[str], corrected_cols: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Metrics of several column pairs stacked in one scan; absent pairs are skipped.

    The words of an original that stands in several pairs are found once.
    """
    if len(original_cols) != len(corrected_cols):
        raise ValueError("as many original columns as corrected columns are needed")
    pairs = [
        (a, b)
        for a, b in zip(original_cols, corrected_cols)
        if not require_columns(df, (a, b), on_missing="warn")
    ]
    originals = list(dict.fromkeys(a for a, _ in pairs))

    def rows(own: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    _analyzed(F.col(a), F.col(b), own[originals.index(a)]).alias("m"),
                    F.lit(a).alias("original_column"),
                    F.lit(b).alias("corrected_column"),
                )
                for a, b in pairs
            ]
        )

    found = let(F.array(*[_distinct_words(F.col(a)) for a in originals]), rows)
    stacked = df.select(*keys, F.explode(found).alias("r"))
    return stacked.select(*keys, "r.m.*", "r.original_column", "r.corrected_column")


def unpivot_models(df: DataFrame, ids: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Long form ``(ids..., model, response)``; by default every other column is a model."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), cols, "model", "response")


def score(df: DataFrame, ref_col: str = "answer", hyp_col: str = "response") -> DataFrame:
    """Add one column per metric, comparing each response with the reference column."""
    toks = df.withColumns(
        {"_ref": S.score_tokens(F.col(ref_col)), "_hyp": S.score_tokens(F.col(hyp_col))}
    )
    ref, hyp = F.col("_ref"), F.col("_hyp")
    return toks.withColumns(
        {
            "bleu": S.bleu(ref, hyp),
            "rouge_l": S.rouge_l(ref, hyp),
            "jsd": S.js_divergence(ref, hyp),
            "jaccard": S.jaccard(ref, hyp),
            "levenshtein": S.levenshtein_sim(F.col(ref_col), F.col(hyp_col)),
        }
    ).drop("_ref", "_hyp")


def score_rows(
    df: DataFrame, ids: Sequence[str], ref_col: str = "answer", cols: Sequence[str] | None = None
) -> DataFrame:
    """Scores of every model for every row: ``(ids..., model, response, metrics...)``."""
    return score(unpivot_models(df, ids, cols), ref_col)


def mean_scores(scores: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """``(model, metric, score)``: averaged wide, with map-side sums, then unpivoted."""
    means = scores.groupBy("model").agg(*[F.avg(m).alias(m) for m in metrics])
    return means.unpivot(["model"], list(metrics), "metric", "score")
