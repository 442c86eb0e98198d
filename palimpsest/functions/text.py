"""Scalar text functions: ``Column`` in, ``Column`` out, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import patterns as P
from palimpsest.functions.arrays import let
from palimpsest.functions.rounding import round_ratio

# The length under which a transcript counts as short.
SHORT_LENGTH = 20


def strip(c: Column) -> Column:
    """Blanks at both ends go; texts without any are not searched."""

    def stripped(t: Column) -> Column:
        edges = F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
        return F.when(edges.rlike(P.WS), F.regexp_replace(t, P.EDGE_BLANKS, "")).otherwise(t)

    return let(c, stripped)


def is_blank(c: Column) -> Column:
    """True for null, empty and all-blank text."""
    return c.isNull() | ~c.rlike(P.NON_WS)


def normalize_blank(c: Column) -> Column:
    """Null becomes ``''``; blanks at both ends go."""
    return strip(F.coalesce(c, F.lit("")))


def char_len_nospace(c: Column) -> Column:
    """Characters other than U+0020; tabs and line ends count."""
    return F.length(F.replace(c, F.lit(" ")))


def tokens(c: Column) -> Column:
    """Blank-separated tokens; empty array for blank text."""
    return F.regexp_extract_all(c, F.lit(P.TOKEN), F.lit(0))


def extract_year(c: Column, mode: str = "digits") -> Column:
    """Year text of a free-form date.

    ``digits`` keeps the first four digits wherever they stand (``June 4, 1948`` gives
    ``4194``); ``first4run`` takes the first run of four digits instead.
    """
    text = F.coalesce(c.cast("string"), F.lit(""))
    if mode == "digits":
        return F.substring(F.regexp_replace(text, "[^0-9]+", ""), 1, 4)
    if mode == "first4run":
        return F.regexp_extract(text, r"(?<![0-9])([0-9]{4})(?![0-9])", 1)
    raise ValueError(f"unknown year mode: {mode}")


def year_number(c: Column) -> Column:
    """Year as an integer; null when there is none."""
    return c.cast("string").try_cast("int")


def year_or_zero(c: Column) -> Column:
    return F.coalesce(year_number(c), F.lit(0))


def length_bucket(c: Column) -> Column:
    """``empty``, ``1-5``, ``6-20`` or ``over_20`` by length after stripping."""
    n = F.length(normalize_blank(c))
    return (
        F.when(n == 0, "empty").when(n <= 5, "1-5").when(n <= 20, "6-20").otherwise("over_20")
    )


def keep_where(c: Column, cond: Column) -> Column:
    return F.when(cond, c).otherwise(F.lit(""))


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def apply_rules(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply ``(pattern, replacement)`` rules one after the other."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def substitute_patterns(c: Column, rules: Iterable[tuple[str, str]] = P.SUBSTITUTIONS) -> Column:
    return apply_rules(c, rules)


def condense_ws(c: Column) -> Column:
    return F.regexp_replace(c, P.BLANK_RUN, " ")


def normalize_spaces(c: Column) -> Column:
    """Runs of two or three spaces become one space, longer runs a line end."""

    def joined(t: Column) -> Column:
        runs = F.regexp_replace(F.regexp_replace(t, " {4,}", "\n"), " {2,3}", " ")
        return F.when(t.contains("  "), runs).otherwise(t)

    return let(c, joined)


# -- artifact search ----------------------------------------------------------------------


def find_sequences(
    c: Column, pattern: str, group: int = 0, exceptions: Iterable[str] = (), hint: str | None = None
) -> Column:
    """All matches of ``pattern`` minus those fitting an exception from their start.

    ``hint`` is a cheap pattern every match must contain; texts without it skip the
    costly one.
    """
    text = F.coalesce(c, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    anchored = [e if e.startswith("^") else f"^(?:{e})" for e in exceptions]
    if anchored:
        either = "|".join(f"(?:{e})" for e in anchored)
        found = F.filter(found, lambda x: ~x.rlike(either))
    if hint:
        found = F.when(text.rlike(hint), found).otherwise(F.array().cast("array<string>"))
    return found


def special_sequences(c: Column) -> Column:
    return find_sequences(c, P.SPECIAL)


def general_sequences(c: Column) -> Column:
    return find_sequences(c, P.GENERAL, exceptions=P.GENERAL_EXCEPTIONS, hint=P.SYMBOL)


def repeat_letters(c: Column) -> Column:
    """The repeated letter of each word that repeats one, not the word itself."""
    return find_sequences(c, P.REPEAT, group=1, hint=P.REPEAT_HINT)


# -- artifact removal ---------------------------------------------------------------------


def _replace_hinted(c: Column, hint: str, pattern: str, replacement: str) -> Column:
    """Replace only where the cheap hint occurs; ``c`` is bound, as it is used three times."""
    return let(
        c, lambda t: F.when(t.rlike(hint), F.regexp_replace(t, pattern, replacement)).otherwise(t)
    )


def remove_special(c: Column) -> Column:
    return F.regexp_replace(c, P.SPECIAL, "")


def remove_general(c: Column) -> Column:
    return _replace_hinted(c, P.SYMBOL, P.GENERAL, "")


def collapse_repeats(c: Column, mode: str = "collapse") -> Column:
    """``collapse`` turns the whole word into its repeated letter (``Helllo`` to ``l``);
    ``squeeze`` keeps the word and shortens the run (``Helllo`` to ``Helo``)."""
    if mode == "collapse":
        return _replace_hinted(c, P.REPEAT_HINT, P.REPEAT, "$1")
    if mode == "squeeze":
        return F.regexp_replace(c, P.REPEAT_RUN, "$1")
    raise ValueError(f"unknown repeat mode: {mode}")


def remove_patterns(c: Column, order: str = "A", repeat_mode: str = "collapse") -> Column:
    """Order A: repeats, special, general.  Order B: special, general, repeats."""
    if order == "A":
        return remove_general(remove_special(collapse_repeats(c, repeat_mode)))
    if order == "B":
        return collapse_repeats(remove_general(remove_special(c)), repeat_mode)
    raise ValueError(f"unknown order: {order}")


def strip_stray_punct(c: Column) -> Column:
    """Drop ``^`` with up to four word characters, and punctuation standing alone."""
    return F.regexp_replace(c, P.CARET, "")


def strip_unclosed_paren(c: Column) -> Column:
    """Drop everything from a ``(`` that is never closed to the end of the text.

    String functions instead of a pattern: linear even for texts full of ``(``.
    """

    def cut(t: Column) -> Column:
        tail = F.substring_index(t, ")", -1)
        at = F.instr(tail, "(")
        kept = F.substring(t, F.lit(1), F.length(t) - F.length(tail) + at - 1)
        return F.when(t.contains("(") & (at > 0), kept).otherwise(t)

    return let(c, cut)


# -- scores and splits --------------------------------------------------------------------


def messy_score(c: Column) -> Column:
    """Suspicious marks, odd spacing and mixed case per character, three decimals."""
    hits = (
        F.regexp_count(c, F.lit(P.SUSPICIOUS))
        + F.regexp_count(c, F.lit(P.ODD_SPACING))
        + F.regexp_count(c, F.lit(P.MIXED_CASE))
    )
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(round_ratio(hits, F.length(c), 3))


def is_messy(score: Column, threshold: float = 0.3) -> Column:
    return F.coalesce(score > F.lit(threshold), F.lit(False))


def sentences(c: Column) -> Column:
    """Sentences with the blanks after them; joining them gives the text back."""
    parts = F.regexp_extract_all(c, F.lit(P.SENTENCE), F.lit(0))
    ends_open = (c == "") | c.rlike(P.OPEN_SENTENCE_END)
    return F.when(ends_open, F.array_append(parts, F.lit(""))).otherwise(parts)


def split_at_ratio(c: Column, ratio: Column | float) -> Column:
    """``struct<first, second>`` cut at the sentence boundary nearest below ``ratio``."""
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))

    def cut(s: Column) -> Column:
        n = F.size(s)
        k = F.floor(n * ratio).cast("int")
        k = F.when(k >= n, n - 1).when(k <= 0, F.lit(1)).otherwise(k)
        return let(
            k,
            lambda at: F.struct(
                F.concat_ws("", F.slice(s, F.lit(1), at)).alias("first"),
                F.concat_ws("", F.slice(s, at + 1, n)).alias("second"),
            ),
        )

    return let(sentences(c), cut)


def changed_flag(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)
