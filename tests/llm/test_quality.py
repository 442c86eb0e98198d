"""Quality counts and estimates against plain Python and NumPy."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import quality_rules as R


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts(docs, odd, frame):
    extra = frame([(1, "a b c a b c a b"), (2, "é ü x # ## <>\n\nq\nq\n \n"), (3, "a a a a"), (4, "a b")])
    for df in (docs, odd, extra):
        for r in R.measured(df, F.col("text").alias("given")).collect():
            assert tuple(r[1:]) == plain_counts(r.given)


def test_verdicts_follow_rules(docs):
    rows = R.verdicts(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.distance <= R.CUTOFF)


def plain_estimate(x, steps=R.STEPS):
    """The same estimate for one group, with exact quartiles and the same histogram."""
    floors = np.array(list(R.VECTOR.values()))
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    mean, cov = q[1], np.diag(np.maximum((q[2] - q[0]) / 1.349, floors) ** 2)

    def bucket(mean, cov):
        y = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)
        return np.floor(np.log((y**2).sum(0) + 1e-6) * 32), (y**2).sum(0)

    for _ in range(steps):
        b, _ = bucket(mean, cov)
        inside = x[b <= np.sort(b)[int(np.ceil(len(b) * R.SUPPORT)) - 1]]
        mean, cov = inside.mean(0), np.cov(inside.T, bias=True)
        cov[np.diag_indices(5)] = np.maximum(np.diag(cov), floors**2)
    b, d = bucket(mean, cov)
    return d / max(1.0, np.exp((np.sort(b)[int(np.ceil(len(b) / 2)) - 1] + 0.5) / 32) / R.MEDIAN)


def test_distances_match_numpy(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(600, 5)) * [0.5, 0.1, 0.1, 0.2, 0.2] + [5, 1.6, 0.2, 0.2, 0.3]
    x[:20] += 3
    rows = [("en", None, *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{v} double" for v in R.VECTOR))
    got = R.judged(df, R.estimates(df)).collect()
    want = {tuple(np.round(v, 9)): d for v, d in zip(x, plain_estimate(x), strict=True)}
    for r in got:
        assert abs(want[tuple(np.round([r[v] for v in R.VECTOR], 9))] - r.distance) < 1e-6 * (1 + r.distance)
    far = [r.distance > R.CUTOFF for r in got]
    assert sum(far) >= 20 and sum(far) < 30


def test_small_groups_use_wider_ones_and_odd_rows(odd, none, frame):
    kept = R.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == 0
    assert R.verdicts(odd).count() == odd.count() and R.verdicts(none).count() == 0 and R.keep_good(none).count() == 0
    text = " ".join(f"word{i}" for i in range(80))
    one = frame([(i, f"{text} {i}", None if i % 2 else "en", None) for i in range(30)])
    assert R.keep_good(one).count() == 30


def test_pipeline_stage_agrees_with_verdicts(docs):
    kept = {r.doc_id for r in R.keep_good(docs).select("doc_id").collect()}
    assert kept == {r.doc_id for r in R.verdicts(docs).collect() if r.kept}


def test_no_python_in_the_plan(docs):
    plan = R.verdicts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
