"""Row-by-row comparison of one column in two tables.

Texts never meet: each side is cut down to a digest of every value, one of the stripped value and
the damaged characters it holds, and only those are joined.  The few values that a report shows are
fetched by the numbers of their rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import strip
from palimpsest.operators.row_identity import with_row_no, zip_rows
from palimpsest.sources.tables import require_columns

# Characters that encodings tend to damage.
ENCODING_CHARS = ('"', ", ", "–", "—")
DIFFERENCES_SHOWN = 10
SAMPLE_ROWS = 5


def reduced(df: DataFrame, col: str, keep: Sequence[str], chars: Sequence[str] = ENCODING_CHARS) -> DataFrame:
    """``keep`` and, for the values of ``col``: ``digest`` and ``stripped`` (128 bits, null for null) and the bits of ``chars``."""
    value = F.col(col).cast("string")
    held = F.lit(0)
    for i, ch in enumerate(chars):
        held = held.bitwiseOR(F.when(value.contains(ch), F.lit(1 << i)).otherwise(0))
    return df.select(*keep, F.unhex(F.md5(value)).alias("digest"), F.unhex(F.md5(strip(value))).alias("stripped"), held.alias("chars"))


def compare_column(
    a: DataFrame,
    b: DataFrame,
    col_a: str,
    col_b: str,
    chars: Sequence[str] = ENCODING_CHARS,
    row_no: str = "row_no",
    start: int = 0,
    differences_shown: int = DIFFERENCES_SHOWN,
    sample_rows: int = SAMPLE_ROWS,
    order_by: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Tables ``summary`` (one row), ``differences`` (the first ``differences_shown``) and
    ``samples`` (the first ``sample_rows``).

    Both inputs are numbered densely from ``start``; with ``order_by`` they have no numbers yet,
    and their digests are numbered in the order of those columns, which must identify a row.  Two
    nulls are equal.  Values are equal if their 128-bit digests are.  Exact-match figures are
    filled when the row counts agree, overlap figures when they do not.
    """
    keys = list(order_by) if order_by else [row_no]
    sides = []
    for side, df, col in (("a", a, col_a), ("b", b, col_b)):
        require_columns(df, [col, *keys])
        digests = reduced(df, col, keys, chars)
        if order_by:
            digests = with_row_no(digests, keys, start, row_no)
        sides.append(digests.withColumnsRenamed({c: f"{c}_{side}" for c in digests.columns if c != row_no}).withColumn(f"in_{side}", F.lit(True)))
    pairs = zip_rows(*sides, on=row_no)
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    same = F.col("digest_a").eqNullSafe(F.col("digest_b"))
    facts = pairs.agg(
        F.count("in_a").alias("rows_a"),
        F.count("in_b").alias("rows_b"),
        F.count_if(both).alias("overlap"),
        F.count_if(both & same).alias("equal"),
        F.count_if(both & F.col("stripped_a").eqNullSafe(F.col("stripped_b"))).alias("equal_stripped"),
        F.count_if(F.col("in_a").isNotNull() & F.col("digest_a").isNull()).alias("nulls_a"),
        F.count_if(F.col("in_b").isNotNull() & F.col("digest_b").isNull()).alias("nulls_b"),
        *[
            F.coalesce(F.bool_or(F.col(f"chars_{side}").bitwiseAND(1 << i) != 0), F.lit(False)).alias(f"{side}_{i}")
            for side in "ab"
            for i in range(len(chars))
        ],
    )
    match = F.col("rows_a") == F.col("rows_b")
    rate = F.when(F.col("overlap") > 0, F.col("equal") / F.col("overlap")).otherwise(0.0)
    issues = [
        F.when(F.col("nulls_a") != F.col("nulls_b"), F.lit("null counts differ")),
        F.when(match & (F.col("equal_stripped") > F.col("equal")), F.lit("whitespace differences")),
        *[
            F.when(F.col(f"a_{i}") != F.col(f"b_{i}"), F.lit(f"only one side has: {ch}"))
            for i, ch in enumerate(chars)
        ],
    ]
    summary = facts.select(
        "rows_a",
        "rows_b",
        match.alias("rows_match"),
        F.when(match, F.col("equal")).alias("exact_matches"),
        F.when(match, rate).alias("exact_match_rate"),
        F.when(match, F.col("overlap") - F.col("equal")).alias("total_differences"),
        F.when(~match, F.col("equal")).alias("exact_matches_overlap"),
        F.when(~match, rate).alias("exact_match_rate_overlap"),
        "nulls_a",
        "nulls_b",
        F.array_compact(F.array(*issues)).alias("potential_issues"),
    )

    def values(chosen: DataFrame) -> DataFrame:
        """Both values of a few chosen rows, fetched by a broadcast of their keys."""
        chosen = chosen.select(row_no, *(c for side in "ab" for c in chosen.columns if order_by and c in {f"{k}_{side}" for k in keys}))
        shown = []
        for side, df, col in (("a", a, col_a), ("b", b, col_b)):
            named = [f"{k}_{side}" for k in keys] if order_by else keys
            marks = chosen.select(row_no, *(F.col(n).alias(f"_key_{i}") for i, n in enumerate(named)))
            fetched = df.select(*(F.col(k).alias(f"_own_{i}") for i, k in enumerate(keys)), F.col(col).cast("string").alias(f"value_{side}"))
            met = reduce(lambda x, y: x & y, (F.col(f"_own_{i}").eqNullSafe(F.col(f"_key_{i}")) for i in range(len(keys))))
            shown.append(fetched.join(F.broadcast(marks), met).select(row_no, f"value_{side}"))
        return zip_rows(*shown, on=row_no)

    first = pairs.where(both & ~same).orderBy(row_no).limit(differences_shown)
    samples = pairs.where(F.col(row_no) < start + sample_rows).orderBy(row_no).limit(sample_rows)
    return {"summary": summary, "differences": values(first), "samples": values(samples)}
