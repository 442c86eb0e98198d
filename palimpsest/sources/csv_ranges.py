"""Byte ranges of CSV files with multi-line cells, so that one large file is many tasks.

The text reader cuts files into ranges of whole lines.  A line starts a record if the quotes before
it in the file are even in number, so each range needs one bit from the ranges before it: their quotes
are counted, and the parities added up over the ranges of a file.  Every range then joins its lines
into records by itself; only the lines at its two ends, which may belong to a record that goes on
across the cut, meet those of the other ranges.  Records go to Spark's own CSV parser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges up to which their bits (a path and two numbers each) are broadcast.
BROADCAST_RANGES = 20_000

INNER, HEAD, OPEN = 0, 1, 2
_PIECES = "file string, range long, kind int, first boolean, record string"
_ARROW = pa.schema([("file", pa.string()), ("range", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("record", pa.string())])


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the ranges of a task, in the order of their lines.

    The lines before a range's first record are its head; its last record stays open.
    """
    at: tuple[str, int] | None = None
    inside, head, held = False, True, []

    def close(kind: int) -> list[tuple[str, int, int, bool, str]]:
        if not held:
            return []
        return [(*at, HEAD if head else kind, first, "\n".join(held))]

    first = False
    for batch in batches:
        out: list[tuple[str, int, int, bool, str]] = []
        quotes = pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False)
        for i, (file, start, before, value) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "range", "before", "value")), strict=True)):
            if (file, start) != at:
                out += close(OPEN)
                at, inside, held, head, first = (file, start), bool(before % 2), [], True, False
                begun = start == 0
            if not inside:
                out += close(INNER)
                head, held, first = False, [], begun
                begun = False
            held.append(value)
            inside ^= bool(quotes[i] % 2)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
    last = close(OPEN)
    if last:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last, strict=True), _ARROW, strict=True)], schema=_ARROW)


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record``: the text of every record of the files but the first of each, the header.

    Quotes must be paired, as in files where cells with quotes are quoted and quotes in them
    doubled; a file with an odd number of quotes is an error.  Empty records are left out.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "range").agg(F.sum(quotes).alias("n"))
    whole = Window.partitionBy("file")
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.sum("n").over(whole) % 2 != 0
    before = F.when(odd, F.raise_error(F.concat(F.lit("unpaired quotes in "), "file"))).otherwise(F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranges = ranges.select("file", "range", before.cast("long").alias("before"))
    if lines.rdd.getNumPartitions() <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
        marked = lines.join(ranges, ["file", "range"])
    else:
        # Sorted by range and line, as a shuffle does not keep the order.
        marked = lines.withColumn("line", F.monotonically_increasing_id()).join(ranges, ["file", "range"])
        marked = marked.repartition("file", "range").sortWithinPartitions("file", "range", "line")
    pieces = marked.select("file", "range", "before", "value").mapInArrow(_pieces, _PIECES)
    # At most a head and an open record for each range: the open one takes the heads that follow.
    ends = pieces.where(F.col("kind") != INNER)
    order = Window.partitionBy("file").orderBy("range", "kind")
    ends = ends.withColumn("owner", F.count_if(F.col("kind") == OPEN).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("range", "kind", "record")))
    joined = ends.groupBy("file", "owner").agg(F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"), F.bool_or("first").alias("first"))
    found = pieces.where(F.col("kind") == INNER).select("first", "record").unionByName(joined.select("first", "record"))
    return found.where(~F.col("first")).select(F.regexp_replace("record", "\r$", "").alias("record")).where("record != ''")
