"""Dictionary-based spelling repair as joins over distinct tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import patterns as P
from palimpsest.operators.quality import unknown_tokens

MAX_EDITS = 2
# Words up to this length are matched by shared deletions, longer ones by shared segments.
LONGEST_BY_DELETION = 24


def build_vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lower-cased words of the columns with their counts: ``(word, freq)``."""
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in cols]))
    words = F.regexp_extract_all(text, F.lit(P.SPELL_WORD), F.lit(0))
    return (
        df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    )


def row_tokens(df: DataFrame, key: str, col: str) -> DataFrame:
    """``(key, word)``: distinct lower-cased words worth checking, per row."""
    words = F.regexp_extract_all(F.lower(F.col(col)), F.lit(P.SPELL_WORD), F.lit(0))
    return df.select(key, F.explode(F.array_distinct(words)).alias("word")).where(
        (F.length("word") > 2) & ~F.col("word").rlike(P.DIGITS)
    )


def _segments(w: Column, length: Column, shifts: Column) -> Column:
    """Keys ``length|part|text`` of the three parts of a word of ``length`` characters.

    Two edits cannot touch all three parts, so a close pair shares one of them, moved by
    at most two places.
    """
    size = F.floor(length / 3).cast("int")

    def part(j: Column) -> Column:
        width = F.when(j == 2, length - size * 2).otherwise(size)
        return F.transform(
            F.filter(shifts, lambda s: j * size + s >= 0),
            lambda s: F.concat_ws("|", length, j, F.substring(w, j * size + s + 1, width)),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), part))


def _token_segments(w: Column) -> Column:
    """Keys under which a dictionary word matched by segments and close to the token ``w`` is found."""
    move = F.sequence(F.lit(-MAX_EDITS), F.lit(MAX_EDITS))
    lengths = F.filter(
        F.transform(move, lambda d: F.length(w) + d), lambda n: n > LONGEST_BY_DELETION
    )
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: _segments(w, n, move))))


def _word_segments(w: Column) -> Column:
    return _segments(w, F.length(w), F.array(F.lit(0)))


def _keyed(df: DataFrame, name: str, longest: int, segments: Column, beyond: int) -> DataFrame:
    """One row per key, as a short hash; a collision only costs a distance computation.

    Words of up to ``longest`` characters give themselves and everything left after deleting one
    or two of their characters; those of more than ``beyond``, which is no more than ``longest``,
    give their ``segments``.  The deletions are made as rows of two places each, not as arrays of
    texts, which took most of the time.
    """
    w, i, j, parts = F.col(name), F.col("_i"), F.col("_j"), F.col("_parts")
    size = F.length(w)
    # The first place deleted, or the length for none; -1 stands for the segments.
    first = F.sequence(
        F.when(size > beyond, -1).otherwise(0), F.when(size <= longest, size).otherwise(-1)
    )
    # The second one behind it, where the length is none again.
    second = F.when(i < 0, F.sequence(F.lit(1), F.size(parts))).otherwise(
        F.sequence(i + 1, F.greatest(size, i + 1))
    )
    rest = F.concat(F.substring(w, F.lit(1), i), F.substring(w, i + 2, j - i - 1), F.substring(w, j + 2, size))
    return (
        df.where(w.isNotNull())
        .withColumn("_parts", F.when(size > beyond, segments))
        .withColumn("_i", F.explode(first))
        .withColumn("_j", F.explode(second))
        .withColumn("shared", F.xxhash64(F.when(i < 0, F.get(parts, j - 1)).otherwise(rest)))
        .drop("_parts", "_i", "_j")
    )


def candidate_pairs(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(token, word, freq, distance)`` for all pairs within two edits (pairs may repeat).

    Found by one equi-join on shared keys; tokens and words are never crossed.
    """
    token, word = F.col("token"), F.col("word")
    probes = _keyed(
        tokens.select("token"), "token", LONGEST_BY_DELETION + MAX_EDITS,
        _token_segments(token), LONGEST_BY_DELETION - MAX_EDITS,
    )
    words = _keyed(
        dictionary.select("word", "freq"), "word", LONGEST_BY_DELETION, _word_segments(word), LONGEST_BY_DELETION
    )
    return (
        probes.join(words, "shared")
        .withColumn("distance", F.levenshtein(token, word, MAX_EDITS))
        .where(F.col("distance") >= 0)
        .drop("shared")
    )


def suggest(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(token, correction)``: nearest word, then most frequent, then first in order."""
    best = F.min(F.struct(F.col("distance"), (-F.col("freq")).alias("rank"), F.col("word")))
    return (
        candidate_pairs(tokens, dictionary)
        .groupBy("token")
        .agg(best["word"].alias("correction"))
    )


def _recase(original: str, correction: str) -> str:
    if original.isupper():
        return correction.upper()
    if original[0].isupper():
        return correction.capitalize()
    return correction


_WORD = re.compile(r"([\w']+)")


@F.pandas_udf(T.StringType())
def _apply_fixes(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Rewrite each text with its own fixes, in one pass over the text."""

    def fix(text: str, wrong: Sequence[str] | None, right: Sequence[str] | None) -> str:
        if text is None or wrong is None:
            return text
        found = dict(zip(wrong, right)).get
        # Every other piece is a word.
        pieces = _WORD.split(text)
        pieces[1::2] = [
            w if (to := found(w.lower())) is None else _recase(w, to) for w in pieces[1::2]
        ]
        return "".join(pieces)

    for texts, wrong, right in batches:
        yield pd.Series([fix(*row) for row in zip(texts, wrong, right)], dtype=object)


def correct_spelling(
    df: DataFrame, key: str, col: str, dictionary: DataFrame, out: str = "corrected_transcript"
) -> DataFrame:
    """Replace unknown words by their best dictionary word, keeping case and surroundings.

    ``key`` identifies rows; ``dictionary`` has ``word`` (lower case) and ``freq``.  Each
    distinct unknown token is resolved once; a row receives only its own fixes.  Words of
    one or two characters, digits and words without a candidate stay as they are.
    """
    tokens = row_tokens(df, key, col)
    unknown = unknown_tokens(tokens, dictionary).withColumnRenamed("word", "token")
    fixes = suggest(unknown.select("token").distinct(), dictionary)
    per_row = (
        unknown.join(fixes, "token")
        .groupBy(key)
        .agg(F.collect_list(F.struct("token", "correction")).alias("_fixes"))
    )
    # Only texts with fixes travel to Python and back.
    touched = F.when(F.col("_fixes").isNotNull(), F.col(col))
    fixed = _apply_fixes(touched, F.col("_fixes.token"), F.col("_fixes.correction"))
    return df.join(per_row, key, "left").withColumn(out, F.coalesce(fixed, F.col(col))).drop("_fixes")
