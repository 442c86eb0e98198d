"""Shared helpers: inputs, tables written to the shared folder, word and key expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import shared_dir

#: Blank characters between words; everything else belongs to a word.
BLANKS = r"[ \x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage with files that survive lost executors.  Files are not removed here,
    as the result stays lazy; clear the folder of ``spark.checkpoint.dir`` after the job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that is made of them is stored itself."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def words(text: Column) -> Column:
    """Words ``[^ \\t-\\r]+`` of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a document by its id and a 64-bit hash of its text.

    Rows equal in both count as one document wherever this key is used.
    """
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"))
