"""Cleaning of files as they arrive.

Every cleaning operator is a stateless projection, so a file stream needs no watermark;
its checkpoint makes a re-run skip the files that are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from palimpsest.plans.cleaning import clean_items


def clean_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    date: str | None = "date",
    text: str = "transcript",
) -> DataFrame:
    """Clean all Parquet files of ``source`` not yet cleaned into ``target``; returns it."""
    items = spark.readStream.schema(schema).parquet(source)
    query = (
        clean_items(items, date, text)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target)
