"""Mixing documents to target weights of predicted domains.

Domains come from the labelled table: ``clean`` (quality 1, not toxic), ``low`` (quality 0) and
``toxic`` (quality 1, toxic).  A multinomial logistic regression over hashed words is fitted on at
most ``SAMPLE`` labelled documents and gives every document its domain posteriors.  Then
nonnegative rates r are sought for which the expected token totals, the sums of
``r * tokens * posterior``, match the targets in the least-squares sense.

All rates start at 1.  Each step aggregates the totals and the posteriors' Gram matrix of the
documents whose rate is not at a bound (a dozen numbers), solves for the gradient in that metric on
the driver, and every document follows it, cut at zero (and at a bound, if one is given).  A document's rate is thus a short formula of
its posteriors, so nothing is joined or shuffled but the sums.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stored, words

DOMAINS = ("clean", "low", "toxic")
#: Share of the tokens that each domain shall have in the mixture.
TARGETS = {"clean": 0.96, "low": 0.02, "toxic": 0.02}
#: A bound for rates where one is asked for; a scarce domain may then fall short of its target.  Query and pipeline have none.
MOST = 4.0
#: Labelled documents to learn from, at most: those with the smallest hash of their id.
SAMPLE = 6000
FEATURES = 1 << 15
STEPS = 12
#: Largest difference of a share from its target at which the steps end.
TOLERANCE = 1e-6


def _domain(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 0, 1.0).when(toxic == 1, 2.0).otherwise(0.0)


def _featured(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """``keep``, ``n`` (words) and ``x`` (hashed words, lower case, presence only)."""
    found = docs.select(*keep, words(F.lower(text)).alias("w"))
    found = found.select("*", F.size("w").cast("long").alias("n"))
    return HashingTF(inputCol="w", outputCol="x", numFeatures=FEATURES, binary=True).transform(found).drop("w")


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LogisticRegressionModel | list[float]:
    """A model of the domains; a list of constant posteriors where labels name fewer than two.

    Labels with a null are left out; of several labels of a document the lowest quality and the
    highest toxicity count.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(_domain(F.min("quality"), F.max("toxic")).alias("label"))
    # At most ``sample`` rows of two numbers: small enough to broadcast at any input size.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # A bounded sample needs few parts; the learner sends a vector of all weights for each of them.
    rows = stored(rows.select("label", "text").repartition(8), "mixing-sample")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return [1.0 if k in counts else 0.0 if counts else 1 / len(DOMAINS) for k in range(len(DOMAINS))]
    learner = LogisticRegression(
        featuresCol="x", labelCol="label", family="multinomial", regParam=1e-3, maxIter=40, standardization=False,
        probabilityCol="p", rawPredictionCol="raw", predictionCol="y",
    )
    return learner.fit(_featured(rows, F.col("text"), F.col("label")))


def posteriors(docs: DataFrame, model: LogisticRegressionModel | list[float], *keep: Column) -> DataFrame:
    """``keep``, ``n`` (words of ``text``) and ``p_0, p_1, p_2`` (domain posteriors)."""
    names = [f"p_{k}" for k in range(len(DOMAINS))]
    if isinstance(model, list):
        base = docs.select(*keep, F.size(words(F.col("text"))).cast("long").alias("n"))
        return base.withColumns({c: F.lit(v) for c, v in zip(names, model, strict=True)})
    rows = _featured(docs, F.col("text"), *keep)
    made = model.transform(rows).withColumn("p", vector_to_array("p"))
    got = model.numClasses
    held = [c for c in rows.columns if c != "x"]
    return made.select(*held, *((F.col("p")[k] if k < got else F.lit(0.0)).alias(c) for k, c in enumerate(names)))


def rate(steps: list[list[float]], most: float = MOST) -> Column:
    """The rate of a document with posteriors ``p_*`` after the given steps."""
    r: Column = F.lit(1.0)
    for g in steps:
        moved = r - sum((F.lit(v) * F.col(f"p_{k}") for k, v in enumerate(g)), F.lit(0.0))
        r = F.least(F.lit(most), F.greatest(F.lit(0.0), moved))
    return r


def fitted_steps(
    rows: DataFrame, targets: dict[str, float] = TARGETS, steps: int = STEPS, most: float = MOST
) -> list[list[float]]:
    """Projected-gradient steps for ``rows(n, p_*)`` that bring the expected shares to the targets.

    Shares are of all tokens before mixing, so the mixture is as large as its input where the
    bounds allow.  The steps end at the smallest squared error seen; after a step that made it
    larger, the next ones go half as far.  A table without tokens has no steps.
    """
    d = len(DOMAINS)
    weights = sum(targets.values())
    goal = [targets[name] / weights for name in DOMAINS]
    total = rows.agg(F.sum("n")).first()[0] or 0
    taken: list[list[float]] = []
    best, found, pace = math.inf, [], 1.0
    for _ in range(steps + 1 if total else 0):
        r = F.col("r")
        free = (r > 0) & (r < most)
        sums = [F.sum(F.col("n") * r * F.col(f"p_{k}")) for k in range(d)]
        gram = [F.sum(F.when(free, F.col("n") * F.col(f"p_{i}") * F.col(f"p_{j}"))) for i in range(d) for j in range(d)]
        got = [(v or 0.0) / total for v in rows.withColumn("r", rate(taken, most)).agg(*sums, *gram).first()]
        over = [a - t for a, t in zip(got[:d], goal, strict=True)]
        error = sum(v * v for v in over)
        if error < best:
            best, found = error, list(taken)
        else:
            pace /= 2
        if max(map(abs, over)) < TOLERANCE or len(taken) == steps:
            break
        step = _solve([got[d + i * d : d + i * d + d] for i in range(d)], over)
        taken.append([pace * v for v in step])
    return found


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small symmetric system, slightly regularised, by elimination with pivots."""
    d = len(right)
    rows = [[v + (1e-4 if i == j else 0.0) for j, v in enumerate(row)] + [right[i]] for i, row in enumerate(matrix)]
    for i in range(d):
        p = max(range(i, d), key=lambda k: abs(rows[k][i]))
        rows[i], rows[p] = rows[p], rows[i]
        for k in range(i + 1, d):
            f = rows[k][i] / rows[i][i]
            rows[k] = [a - f * b for a, b in zip(rows[k], rows[i], strict=True)]
    out = [0.0] * d
    for i in reversed(range(d)):
        out[i] = (rows[i][d] - sum(rows[i][j] * out[j] for j in range(i + 1, d))) / rows[i][i]
    return [v if math.isfinite(v) else 0.0 for v in out]


def copies(r: Column, *identity: Column) -> Column:
    """Whole copies for a rate: its floor, and one more with the fraction's chance by a hash."""
    draw = F.pmod(F.xxhash64(F.lit("mixing"), *identity), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(r) + F.when(draw < r - F.floor(r), 1).otherwise(0)).cast("long")


def mixed_rates(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: float = math.inf
) -> DataFrame:
    """One row per document: ``doc_id``, ``tokens``, posteriors by domain, ``rate``, ``copies`` and the shares.

    Tokens are words.  Null and blank texts have none and the posteriors of no words.  Rows equal
    in id and text get equal rates and copies.  ``target_*`` and ``reached_*``, alike in all rows, are
    the share of the tokens that each domain shall have and the one that the rates give it (null
    without tokens).  ``most`` bounds the rates.  Other columns are ignored.
    """
    model = trained(docs, labels)
    rows = stored(posteriors(docs, model, F.col("doc_id"), F.xxhash64("text").alias("h")), "posteriors")
    steps = fitted_steps(rows, targets, most=most)
    got = reached(rows, steps, most)
    weights = sum(targets.values())
    named = [F.col(f"p_{k}").alias(f"p_{name}") for k, name in enumerate(DOMAINS)]
    shares = [c for k, name in enumerate(DOMAINS) for c in (
        F.lit(targets[name] / weights).alias(f"target_{name}"), F.lit(got[k]).cast("double").alias(f"reached_{name}"))]
    made = rows.withColumn("rate", rate(steps, most))
    return made.select(
        "doc_id", F.col("n").alias("tokens"), *named, "rate", copies(F.col("rate"), F.col("doc_id"), F.col("h")).alias("copies"), *shares
    )


def reached(rows: DataFrame, steps: list[list[float]], most: float = math.inf) -> list[float | None]:
    """Each domain's share of the tokens of ``rows(n, p_*)`` before mixing, under the rates."""
    sums = [F.sum(F.col("n") * F.col("r") * F.col(f"p_{k}")) for k in range(len(DOMAINS))]
    total, *got = rows.withColumn("r", rate(steps, most)).agg(F.sum("n"), *sums).first()
    return [v / total if total else None for v in got]


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: float = math.inf) -> DataFrame:
    """The documents, each repeated by its whole copies (none: it goes); same columns."""
    model = trained(docs, labels)
    rows = stored(posteriors(docs, model), "posteriors")
    r = rate(fitted_steps(rows, targets, most=most), most)
    found = posteriors(docs, model, F.struct("*").alias("row"), F.xxhash64("text").alias("h"))
    n = copies(r, F.col("row.doc_id"), F.col("h"))
    found = found.select("row", n.alias("copies"))
    # The outer form: Spark would push a plain explode's filter on the copies below the classifier
    # and run that many times for each row.
    each = F.explode_outer(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")
    return found.select("row", each).where("one is not null").select("row.*")
