"""CSV in and out, with multi-line quoted cells and doubled quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.parsing import format_list_literal
from palimpsest.sources.csv_ranges import records
from palimpsest.sources.schema import ITEM_HEADERS, ITEM_SCHEMA

COMMON = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_items_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str = ITEM_SCHEMA,
    undouble_backslashes: bool = False,
    by_ranges: bool = False,
) -> DataFrame:
    """Scan CSV with a declared schema; columns are found by the names in the header.

    Headers may be the item table's own (``ITEM_HEADERS``) or the schema's names, in any
    order; a missing one is an error, others are left out.  All files of a path need the
    same header, which Spark checks.  ``undouble_backslashes`` is for files whose writer escaped every backslash with
    another one.  Cells may span lines, so one file is one task; ``by_ranges`` cuts large files
    into many tasks, for one more pass over the text (see ``csv_ranges``).
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = spark.read.options(**COMMON, multiLine=True, inferSchema=False).csv(path).columns
    known = {f.name: f for f in wanted}
    names = [h if h in known else ITEM_HEADERS.get(h, h) for h in header]
    if missing := [c for c in known if c not in names]:
        raise ValueError(f"missing columns {missing}; the file has {header}")
    in_file = T.StructType(
        [T.StructField(h, known[n].dataType if n in known else T.StringType()) for h, n in zip(header, names, strict=True)]
    )
    if by_ranges:
        options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"}
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in in_file)
        parsed = F.from_csv("record", ddl, options)
        df = records(spark, path).select(parsed.alias("r")).select("r.*")
    else:
        df = (
            spark.read.schema(in_file)
            .options(**COMMON, multiLine=True, mode="FAILFAST", enforceSchema=False)
            .csv(path)
        )
    df = df.select(*(F.col(f"`{header[names.index(c)]}`").alias(c) for c in known))
    if undouble_backslashes:
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        df = df.withColumns({c: F.replace(F.col(c), F.lit("\\\\"), F.lit("\\")) for c in texts})
    return df


def write_items_csv(
    df: DataFrame,
    path: str,
    quote_all: bool = True,
    mode: str = "errorifexists",
    max_records_per_file: int = 0,
) -> None:
    """Write CSV; list columns go out as printed lists (see ``parse_list_literal``)."""
    lists = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)
    ]
    df = df.withColumns({c: format_list_literal(F.col(c)) for c in lists})
    (
        df.write.mode(mode)
        .options(
            **COMMON,
            quoteAll=quote_all,
            lineSep="\n",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            maxRecordsPerFile=max_records_per_file,
        )
        .csv(path)
    )
