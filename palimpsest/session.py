"""Session-level helpers: the shared work folder and the layout of inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
INPUT_PARTITIONS = "spark.palimpsest.inputPartitions"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, seen by every executor.

    Only a local session may fall back to a temporary folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, "") or spark.sparkContext.getConf().get(CHECKPOINT_DIR, "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="palimpsest-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal an input out anew into ``spark.palimpsest.inputPartitions`` partitions, where that is set.

    For inputs of one small file, which a single task would read and clean.  Nothing is
    measured: without the setting, as on large tables, the reader's own splits stay.
    """
    count = df.sparkSession.conf.get(INPUT_PARTITIONS, "")
    return df.repartition(int(count), *keys) if count else df
