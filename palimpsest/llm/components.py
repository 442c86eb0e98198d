"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that occurs in ``links(a, b)``; component = smallest node.

    Each round joins every node to the smallest node around it, first for larger neighbours
    and then for smaller ones, until the links form stars.  Only minima are grouped (with
    partial aggregation), and the links of a node with many neighbours go through an ordinary
    join whose large partitions adaptive execution splits.  Every round is written to the
    shared folder, so lost executors cost one round at most.  Self-links and null ends are ignored.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(rounds):
        # Large star: larger neighbours of a node move to the smallest node around it.
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "large")
        # Small star: a node and its smaller neighbours meet at the smallest of them.
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        sums = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
