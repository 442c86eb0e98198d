"""Mixing rates against a plain fold of the same steps, and their totals against the targets."""

import numpy as np
import pytest

from palimpsest.llm import mixing as M


def test_totals_match_targets(spark):
    draw = np.random.default_rng(1)
    p = draw.dirichlet([3, 0.5, 0.5], 800)
    n = draw.integers(1, 500, 800)
    rows = [(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)]
    df = spark.createDataFrame(rows, "n long, p_0 double, p_1 double, p_2 double")
    targets = {"clean": 0.8, "low": 0.15, "toxic": 0.05}
    steps = M.fitted_steps(df, targets)
    r = np.ones(800)
    for g in steps:
        r = np.clip(r - p @ np.array(g), 0, M.MOST)
    shares = (n * r) @ p / n.sum()
    assert np.abs(shares - [0.8, 0.15, 0.05]).max() < 1e-3
    got = [x[0] for x in df.withColumn("r", M.rate(steps)).select("r").collect()]
    assert sorted(got) == pytest.approx(sorted(r))


def test_scarce_domain_ends_at_the_bound(spark):
    df = spark.createDataFrame([(10, 1.0, 0.0, 0.0)] * 50 + [(1, 0.0, 1.0, 0.0)], "n long, p_0 double, p_1 double, p_2 double")
    steps = M.fitted_steps(df, {"clean": 0.5, "low": 0.5, "toxic": 0.0})
    rates = {r.p_1: r.r for r in df.withColumn("r", M.rate(steps)).collect()}
    assert rates[1.0] == pytest.approx(M.MOST) and rates[0.0] == pytest.approx(0.5, abs=0.01)
    assert M.fitted_steps(df.limit(0)) == []


def test_scarce_domain_reaches_its_target_without_a_bound(spark, frame):
    df = spark.createDataFrame([(10, 1.0, 0.0, 0.0)] * 50 + [(1, 0.0, 1.0, 0.0)], "n long, p_0 double, p_1 double, p_2 double")
    steps = M.fitted_steps(df, {"clean": 0.5, "low": 0.5, "toxic": 0.0}, most=np.inf)
    assert M.reached(df, steps) == pytest.approx([0.5, 0.5, 0.0], abs=0.01)
    rows = [(i, "good words in here") for i in range(60)] + [(60, "poor text")]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(61)], "doc_id long, quality int, toxic int")
    got = M.mixed_rates(frame(rows), labels, {"clean": 0.7, "low": 0.3, "toxic": 0.0}).collect()
    assert max(r.rate for r in got) > M.MOST and got[0].target_low == pytest.approx(0.3)
    assert got[0].reached_low == pytest.approx(sum(r.tokens * r.rate * r.p_low for r in got) / sum(r.tokens for r in got))
    assert got[0].reached_low == pytest.approx(0.3, abs=0.01)


def test_rates_and_mixture(docs, labels):
    rates = M.mixed_rates(docs, labels).collect()
    assert len(rates) == docs.count()
    want = sum(r.copies for r in rates)
    mixed = M.mixture(docs, labels)
    assert mixed.columns == docs.columns and mixed.count() == want
    known = {r.doc_id: r.quality for r in labels.collect()}
    good = [r.rate for r in rates if known.get(r.doc_id) == 1]
    bad = [r.rate for r in rates if known.get(r.doc_id) == 0]
    assert np.mean(good) > np.mean(bad)


def test_odd_rows(odd, none, labels, spark):
    assert M.mixed_rates(odd, labels).count() == odd.count()
    assert M.mixture(odd, labels).columns == odd.columns
    assert M.mixed_rates(none, labels).count() == 0 and M.mixture(none, labels).count() == 0
    empty = labels.limit(0)
    assert {round(r.p_clean, 9) for r in M.mixed_rates(odd, empty).collect()} == {round(1 / 3, 9)}
    nulls = spark.createDataFrame([(4, None, 1), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.p_clean for r in M.mixed_rates(odd, nulls).collect()} == {1.0}


def test_no_python_in_the_plan(docs, labels):
    plan = M.mixture(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
