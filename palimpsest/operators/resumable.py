"""Generation that can be stopped and run again: only what is missing or failed is asked.

A job is a folder of replies.  Prompts are known by a digest, so equal prompts are asked once, and
a question is a digest with a sample number.  Open questions are dealt into batches by their
digest, and the replies to each batch are written before the next is asked; a job that is lost
keeps all batches but one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.generate import BatchFn, generate

REPLIES = "digest string, sample int, response string, error string, attempt int"


def _digest(prompt_col: str):
    return F.sha2(F.col(prompt_col), 256)


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """The last reply to each question so far: ``digest, sample, response, error, attempt``; a success beats any failure."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], REPLIES)
    found = spark.read.schema(REPLIES).option("recursiveFileLookup", True).parquet(folder)
    best = F.struct(F.col("error").isNull().alias("ok"), "attempt", "response", "error")
    return found.groupBy("digest", "sample").agg(F.max(best).alias("r")).select("digest", "sample", "r.response", "r.error", "r.attempt")


def ask_missing(
    df: DataFrame,
    prompt_col: str,
    make_fn: Callable[[], BatchFn],
    folder: str,
    num_samples: int = 1,
    batch_size: int = 10,
    batches: int = 1,
    partitions: int | None = None,
    attempts: int = 3,
) -> int:
    """Asks every question that has no reply and fewer than ``attempts`` failures; returns how many were asked.

    Null prompts are never asked.  Each of ``batches`` batches is one write, so a run that is stopped
    loses one batch at most.
    """
    spark = df.sparkSession
    prompts = df.where(F.col(prompt_col).isNotNull()).groupBy(_digest(prompt_col).alias("digest")).agg(F.first(prompt_col).alias("prompt"))
    asked = 0
    for batch in range(batches):
        part = prompts.where(F.pmod(F.xxhash64("digest"), F.lit(batches)) == batch)
        questions = part.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(num_samples))))
        known = replies(spark, folder).withColumnRenamed("attempt", "tried").select("digest", "sample", "error", "tried")
        missing = (
            questions.join(known, ["digest", "sample"], "left")
            .where(F.col("tried").isNull() | (F.col("error").isNotNull() & (F.col("tried") < attempts)))
            .select("digest", F.col("sample").alias("nth"), "prompt", (F.coalesce("tried", F.lit(0)) + 1).alias("attempt"))
        )
        if partitions:
            missing = missing.repartition(partitions, "digest", "nth")
        made = generate(missing, "prompt", make_fn, 1, batch_size)
        place = f"{folder.rstrip('/')}/asked-{_next(spark, folder)}"
        made.select("digest", F.col("nth").alias("sample"), "response", "error", "attempt").write.parquet(place)
        asked += spark.read.schema(REPLIES).parquet(place).count()
    return asked


def _next(spark: SparkSession, folder: str) -> int:
    """Number of the next write: one more than those that are there, whether committed or not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return len(fs.listStatus(path)) if fs.exists(path) else 0


def with_replies(df: DataFrame, prompt_col: str, folder: str, num_samples: int = 1) -> DataFrame:
    """``df`` with ``sample`` (from 1), ``response`` and ``error``, as ``generate`` gives them, from the replies so far.

    Rows of equal prompts share their replies.  A question that was never asked, and a null prompt,
    has neither response nor error.
    """
    known = replies(df.sparkSession, folder).select("digest", "sample", "response", "error")
    samples = df.withColumns({"digest_of_prompt": _digest(prompt_col), "sample": F.explode(F.sequence(F.lit(1), F.lit(num_samples)))})
    known = known.withColumnRenamed("digest", "digest_of_prompt")
    return samples.join(known, ["digest_of_prompt", "sample"], "left").select(*df.columns, "sample", "response", "error")
