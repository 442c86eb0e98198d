"""Readability gate for transcripts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import patterns as P
from palimpsest.functions import text as X
from palimpsest.functions.arrays import let

# ---------------------------------------------------------------------------------------
# Common English words and the default limits.
# ---------------------------------------------------------------------------------------
COMMON_WORDS = (
    "the", "and", "to", "of", "a", "in", "is", "it", "you", "that",
    "he", "was", "for", "on", "are", "as", "with", "his", "they",
    "i", "at", "be", "this", "have", "from", "or", "one", "had",
    "by", "word", "but", "not", "what", "all", "were", "we", "when",
)


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    min_avg_word_length: float = 3
    min_common_word_ratio: float = 0.1
    max_single_char_ratio: float = 0.3
    max_non_alpha_ratio: float = 0.5
    min_distinct_ratio: float = 0.3
    max_misspell_ratio: float = 0.5
    min_checked_length: int = 3


# ---------------------------------------------------------------------------------------

def _checked_word(limits: Limits) -> str:
    return f"(?<!{P.W})[a-z]{{{limits.min_checked_length},}}(?!{P.W})"


def text_stats(c: Column) -> Column:
    """Struct of the counts the gate needs, from one list of tokens and one of plain words."""

    def counts(tokens: Column, alpha: Column) -> Column:
        return F.struct(
            F.size(tokens).alias("n_words"),
            F.size(F.filter(tokens, lambda w: F.length(w) == 1)).alias("n_single"),
            F.size(F.filter(tokens, lambda w: w.rlike(r"^\p{L}+$"))).alias("n_letters_only"),
            F.size(alpha).alias("n_alpha"),
            F.length(F.array_join(alpha, "")).alias("n_alpha_chars"),
            F.size(F.array_distinct(alpha)).alias("n_alpha_distinct"),
            # Common words are plain words, so they are among those found already.
            F.size(F.filter(alpha, lambda w: w.isin(*COMMON_WORDS))).alias("n_common"),
        )

    alpha = F.regexp_extract_all(F.lower(c), F.lit(P.ALPHA_WORD), F.lit(0))
    return let(X.tokens(c), lambda t: let(alpha, lambda a: counts(t, a)))


def fail_reason(s: Column, blank: Column, limits: Limits = Limits()) -> Column:
    """Name of the first failed test, null when all pass; ``s`` is a struct of ``text_stats``."""
    words = s["n_words"]
    mean_length = s["n_alpha_chars"] / F.greatest(F.lit(1), s["n_alpha"])
    return (
        F.when(blank, "blank")
        .when(words < limits.min_words, "too_few_words")
        .when(s["n_single"] / words > F.lit(limits.max_single_char_ratio), "single_chars")
        .when((words - s["n_letters_only"]) / words > F.lit(limits.max_non_alpha_ratio), "non_alpha")
        .when(mean_length < F.lit(float(limits.min_avg_word_length)), "short_words")
        .when(
            s["n_alpha_distinct"] < s["n_alpha"] * F.lit(limits.min_distinct_ratio), "low_variety"
        )
        .when(F.try_divide(s["n_common"], s["n_alpha"]) < F.lit(limits.min_common_word_ratio), "few_common_words")
    )


def high_quality(
    df: DataFrame,
    col: str,
    dictionary: DataFrame | None = None,
    key: str | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Add ``quality_transcript`` and ``fail_reason``.

    Without a dictionary this is one narrow projection.  With one (``word`` column, and a
    ``key`` identifying rows), texts that pass are also checked for unknown words.
    """
    text = F.coalesce(F.col(col), F.lit(""))
    gated = (
        df.withColumn("_stats", text_stats(text))
        .withColumn("fail_reason", fail_reason(F.col("_stats"), X.is_blank(F.col(col)), limits))
        .drop("_stats")
    )
    if dictionary is not None:
        if key is None:
            raise ValueError("the dictionary test needs the row key")
        # All texts are looked up, as an earlier reason wins anyway: to leave out those that failed
        # would count every pattern of every text a second time.
        ratios = misspell_ratios(df.select(key, col), key, col, dictionary, limits)
        bad = ratios.where(F.col("misspell_ratio") > F.lit(limits.max_misspell_ratio))
        gated = (
            gated.join(bad.select(key, F.lit("misspelled").alias("_bad")), key, "left")
            .withColumn("fail_reason", F.coalesce("fail_reason", "_bad"))
            .drop("_bad")
        )
    return gated.withColumn("quality_transcript", F.col("fail_reason").isNull())


def unknown_tokens(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Rows of ``words`` whose word is not in the dictionary."""
    return words.join(dictionary.select(word).distinct(), word, "left_anti")


def misspell_ratios(
    df: DataFrame, key: str, col: str, dictionary: DataFrame, limits: Limits = Limits()
) -> DataFrame:
    """Distinct unknown words over all checked words, per row that has unknown words.

    Only (key, word, count) travels to the dictionary join, one row per distinct word of
    a text; the text itself stays behind.
    """
    lower = F.lower(F.col(col))
    checked = F.regexp_extract_all(lower, F.lit(_checked_word(limits)), F.lit(0))
    words = df.select(key, checked.alias("_checked")).select(
        key,
        F.size("_checked").alias("n_checked"),
        F.explode(F.array_distinct("_checked")).alias("word"),
    )
    return (
        unknown_tokens(words, dictionary)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_unknown"), F.first("n_checked").alias("n_checked"))
        .withColumn("misspell_ratio", F.col("n_unknown") / F.col("n_checked"))
    )
