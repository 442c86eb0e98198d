"""Exact search against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import topk_search as T


def plain(rows, k):
    made = {i: [int(np.floor(64 * float(c))) for c in v] for i, v in rows}
    out = []
    for q in (i for i in made if i % 20 == 0):
        scores = [(-sum(a * b for a, b in zip(made[q], v)), i) for i, v in made.items() if i != q]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def got(df, k=T.K):
    return sorted(map(tuple, T.top_k(T.whole_vectors(df), F.col("vec_id") % 20 == 0, k).collect()))


def test_matches_all_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert got(df) == plain([(r.vec_id, r.embedding) for r in df.collect()], T.K)


def test_many_rings_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "RING_ROWS", 40)
    monkeypatch.setattr(T, "BLOCK", 64)
    monkeypatch.setattr(T, "CHUNK", 16)
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.1 * draw.normal(size=8)).tolist()) for i in range(1500)]
    rows += [(i, centres[0].tolist()) for i in range(1500, 2200)]  # one vector in a third of all rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert got(df, 7) == plain(rows, 7)


def test_odd_rows(spark):
    rows = [
        (None, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [None, 1.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]),
        (1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [-1e6, 3e5]), (4, [1.0]), (100, []),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    kept = [r for r in rows if r[0] in (0, 1, 2, 3, 4, 100)]
    assert got(df) == plain(kept, T.K)
    assert got(df.limit(0)) == []
    assert got(df.where("vec_id = 0")) == []


@pytest.mark.parametrize("size", [1e12])
def test_large_components_stay_exact(spark, size):
    rows = [(i, [size / 64 + i, -3.0 * i]) for i in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = [(i, [min(v, 1e7) for v in vec]) for i, vec in rows]
    assert got(spark.createDataFrame(small, df.schema)) == plain(small, T.K)


def test_most_annuli_are_ruled_out(spark):
    """On clustered vectors fewer than half of all pairs of query and annulus are met."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.05 * draw.normal(size=16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    vectors = T.whole_vectors(df).cache()
    _, annuli = T.indexed(vectors)
    queries = T.chunked(vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))
    best = {q: s for q, r, _, s in plain(rows, 20) if r == 20}
    least = spark.createDataFrame(list(best.items()), "query_id long, least long")
    early = T.asks(annuli, queries, 20, True)
    late = T.asks(annuli, queries.join(least, "query_id"), 20, False)
    met = sum(d.select(F.sum(F.size("annuli"))).first()[0] or 0 for d in (early, late))
    assert len(annuli.owner) >= 60 and met < 0.5 * 200 * (annuli.sizes > 0).sum()
    assert got(df) == plain(rows, 20)
