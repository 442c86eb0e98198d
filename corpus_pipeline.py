"""From raw documents to packed training sequences, in five stages.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over all that the stage before
kept.  Its result is written as Parquet and read again as the next stage's documents, so a lost
executor costs one stage at most.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import line_dedup, mixing, packing, quality_rules, simhash_dedup
from palimpsest.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated line runs; ``n_chars`` is counted anew where a text changed."""
    done = line_dedup.remove_repeated_runs(docs)
    n = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n.cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dedup.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by the rates that bring the domains to their targets."""
    return mixing.mixture(docs, table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place; ``ids`` are left to the tokenizer."""
    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: Fingerprints, classifiers and packing cannot be said in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
