"""Removal of repeated line runs by winnowing.

A document is its sequence of non-blank lines (exact text, cut at ``\\n``).  Every ``GRAM``
consecutive lines have a hash, and of every ``WINDOW`` consecutive hashes the smallest (the
rightmost of equals) is selected.  Selection looks at nothing outside the window, so any run of
``GRAM + WINDOW - 1`` lines that stands in two places has a selected hash in both.  A long line, of
``LONG_WORDS`` words or ``LONG_CHARS`` characters or more, is a fingerprint of its own besides.

Guaranteed matches are therefore every run of three lines, and every single long line.  Positions with a
shared fingerprint are extended both ways: from a selected hash to all runs of three lines around it,
from a long line to its neighbours, and overlapping runs make up the full length of a match.  A run
whose equal stands earlier, in the order of document id, text hash and line, is removed.  Short lines
that are repeated alone, or in twos, stay.  Nothing is compared pair by pair: a passage in a third of
all documents costs one row for each of its places.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

#: Lines hashed together, and hashes in a window: runs of 3 lines are found for certain.
GRAM = 2
WINDOW = 2
#: Words, or characters, from which a line is long.
LONG_WORDS = 5
LONG_CHARS = 40
_BLANK = " \t\n\x0b\f\r"

_MARKS = "id long, h long, mark long, around array<struct<start: int, hash: long, first: int, last: int>>"
_RUN = pa.struct([("start", pa.int32()), ("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_ARROW = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("mark", pa.int64()), ("around", pa.list_(_RUN))])


def is_long(line: bytes) -> bool:
    """Whether a line is a fingerprint of its own."""
    return len(line) >= LONG_CHARS and len(line.decode("utf-8", "surrogatepass")) >= LONG_CHARS or len(line.split()) >= LONG_WORDS


def _marks_of(text: str, gram: int, window: int) -> Iterator[tuple[int, list[dict[str, int]]]]:
    """Fingerprints of one text, each with the runs around it."""
    digest = xxhash.xxh64_intdigest
    found = [(i, line.encode("utf-8", "surrogatepass")) for i, line in enumerate(text.split("\n")) if line.strip(_BLANK)]
    n = len(found)
    if not n:
        return
    at = [i for i, _ in found]
    hashes = np.array([digest(line) for _, line in found], np.uint64)
    runs = {m: _rolled(hashes, m).view(np.int64).tolist() for m in {1, 2, gram, gram + window - 1}}

    def around(m: int, starts: Iterable[int]) -> list[dict[str, int]]:
        return [{"start": s, "hash": runs[m][s], "first": at[s], "last": at[s + m - 1]} for s in starts if 0 <= s <= n - m]

    for p, (_, line) in enumerate(found):
        if is_long(line):
            yield runs[1][p], around(1, [p]) + around(2, [p - 1, p])
    length = gram + window - 1
    if n >= length:
        # Window i holds the hashes i to i + window - 1; the reversed search gives the rightmost minimum.
        grams = np.array(runs[gram], np.int64).view(np.uint64)
        views = np.lib.stride_tricks.sliding_window_view(grams, window)
        best = np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1))
        for p in best.tolist():
            yield runs[gram][p], around(length, range(p - window + 1, p + 1))


def _rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive hashes: xxHash64 over their bytes."""
    raw, digest = hashes.tobytes(), xxhash.xxh64_intdigest
    return np.array([digest(raw[i : i + 8 * length]) for i in range(0, len(raw) - 8 * length + 1, 8)], np.uint64)


def selected(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints: ``key``, ``mark`` and the runs ``around`` each, ``(start, hash, first, last)``.

    ``start`` counts non-blank lines; ``first`` and ``last`` are places among all lines.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"id": i, "h": h, "mark": m, "around": around}
                for i, h, text in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "text")), strict=True)
                for m, around in _marks_of(text, gram, window)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    made = texts.where("text is not null").mapInArrow(mark, _MARKS)
    return made.select(F.struct("id", "h").alias("key"), "mark", "around")


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Runs to remove, as ``(key, first, last)``, places among all lines of the document."""
    marks = stored(selected(docs, gram, window), "marks")
    shared = stored(marks.groupBy("mark").count().where("count > 1").select("mark"), "shared-marks")
    runs = marks.join(shared.hint("merge"), "mark", "left_semi").select("key", F.explode("around").alias("r")).select("key", "r.*")
    runs = stored(runs, "runs")
    place = F.struct("key.id", "key.h", "start")
    ends = runs.groupBy("hash").agg(F.min(place).alias("origin"), F.max(place).alias("end"))
    again = stored(ends.where("origin < end").select("hash", "origin"), "repeated-runs")
    return runs.join(again.hint("merge"), "hash").where(place > F.col("origin")).select("key", "first", "last")


def remove_repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` rewritten and two counts added: ``n_lines`` and ``n_removed``.

    Blank lines inside a removed run go with it.  Null and blank texts have no runs and stay as
    they are; a text whose lines all go becomes empty.  Rows equal in id and text count as one
    document and get the same text; a null id is the smallest.  Extra columns stay, under any name
    but ``n_lines`` and ``n_removed``, which are replaced.
    """
    gone = repeated_runs(docs, gram, window).select(
        "key", F.sequence(F.col("first").cast("int"), F.col("last").cast("int")).alias("places")
    )
    gone = gone.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("gone"))
    gone = stored(gone.select(F.col("key.id").alias("id"), F.col("key.h").alias("h"), "gone"), "gone-lines")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("h2"))
    # Sorted and merged at every size: a broadcast that ends at some size would change the plan there.
    met = rows.join(gone.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("h2") == F.col("h")), "left")
    lines = F.split(F.col("row.text"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    met = met.select("row", "gone", lines.alias("lines"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    )
    counts = F.coalesce(F.size("lines"), F.lit(0)), F.coalesce(F.size("gone"), F.lit(0))
    return met.select(
        *(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")),
        F.greatest(counts[0], F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(counts[1], F.lit(0)).cast("long").alias("n_removed"),
    )
