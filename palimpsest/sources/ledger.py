"""An append-only table of finished paths, so that no folder has to be listed.

A ledger is a folder of generations ``generation=0``, ``generation=1``, ... of Parquet files with
one row per finished path.  Runs append to the newest generation; ``compact`` writes the distinct
rows of the newest one as the next, which counts from the moment its write is committed.  Nothing is
changed or removed, so a reader, or a run that fails half-way, never sees half a generation.  One
writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, run string"
_GENERATION = "generation="

#: A fetcher takes ``(url, path)`` pairs and returns an error, or None for success, for each.
FetchFn = Callable[[list[tuple[str, str]]], list[str | None]]
_FETCHED = pa.schema([("path", pa.string()), ("error", pa.string())])


def _newest(spark: SparkSession, folder: str) -> int:
    """The newest committed generation; only the folder's own entries are listed, not the files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    names = [s.getPath() for s in fs.listStatus(path)]
    done = [p.getName() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max((int(n.removeprefix(_GENERATION)) for n in done if n.startswith(_GENERATION)), default=0)


def _place(folder: str, generation: int) -> str:
    return f"{folder.rstrip('/')}/{_GENERATION}{generation}"


def append(paths: DataFrame, folder: str, run: str, path: str = "path") -> None:
    """Adds finished paths.  Null paths are left out; repeated ones do no harm."""
    rows = paths.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.lit(run).alias("run"))
    rows.write.mode("append").parquet(_place(folder, _newest(paths.sparkSession, folder)))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, run)`` of the newest generation, repeats included; a ledger not begun is empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_place(folder, _newest(spark, folder)))
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.range(0).select(F.lit("").alias("path"), F.lit("").alias("run"))
    return spark.read.schema(SCHEMA).parquet(place.toString())


def compact(spark: SparkSession, folder: str, files: int = 16) -> None:
    """Writes each path once, with its first run, as the next generation of ``files`` files."""
    rows = read(spark, folder).groupBy("path").agg(F.min("run").alias("run"))
    rows.repartition(files, "path").write.mode("overwrite").parquet(_place(folder, _newest(spark, folder) + 1))


def pending(plan: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Rows of the plan whose path is not in the ledger: one equi-join on the path.

    Rows with a null path are never pending, as nothing could be recorded for them.
    """
    done = read(plan.sparkSession, folder).select(F.col("path").alias(path)).distinct()
    return plan.where(F.col(path).isNotNull()).join(done, path, "left_anti").select(*plan.columns)


def fetch_pending(
    plan: DataFrame, folder: str, make_fetch: Callable[[], FetchFn], run: str, url: str = "img_url", path: str = "path", batch_size: int = 100
) -> DataFrame:
    """Fetches what is pending, adds the successes to the ledger and returns ``(path, error)`` of the failures.

    ``make_fetch`` runs once per task; a batch that fails as a whole is tried row by row.  A path
    planned more than once is fetched once.  What a lost run had not yet recorded is fetched again by the next.
    """
    todo = pending(plan, folder, path).groupBy(path).agg(F.min(url).alias("url")).select("url", F.col(path).alias("path"))

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = make_fetch()
        for batch in batches:
            rows = list(zip(batch.column("url").to_pylist(), batch.column("path").to_pylist(), strict=True))
            for i in range(0, len(rows), batch_size):
                part = rows[i : i + batch_size]
                yield pa.RecordBatch.from_arrays([pa.array([p for _, p in part]), pa.array(_outcomes(fetch, part), pa.string())], schema=_FETCHED)

    spark = plan.sparkSession
    place = f"{folder.rstrip('/')}/outcomes/{run}"
    todo.mapInArrow(fetched, "path string, error string").write.parquet(place)
    outcomes = spark.read.schema("path string, error string").parquet(place)
    append(outcomes.where("error IS NULL"), folder, run)
    return outcomes.where("error IS NOT NULL")


def _outcomes(fetch: FetchFn, rows: list[tuple[str, str]]) -> list[str | None]:
    try:
        errors = list(fetch(rows))
        if len(errors) != len(rows):
            raise ValueError(f"{len(errors)} outcomes for {len(rows)} paths")
        return errors
    except Exception as e:
        return [str(e) or type(e).__name__] if len(rows) == 1 else [_outcomes(fetch, [r])[0] for r in rows]
