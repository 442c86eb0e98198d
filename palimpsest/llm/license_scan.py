"""Licence scan: which paragraphs name or quote which licence.

Comment marks are dropped, and lines that go on in the middle of a sentence (that end in a letter, a
digit, a comma or the like) are joined to the next, so a paragraph is a line, or a notice wrapped at any width.

A multinomial logistic regression over sparse word n-grams (one to three words) is trained on the
notices and names of ``license_texts``: whole, with words left out, and embedded among other words.  The
class ``unknown`` learns from sentences about rights that name no licence, from shuffled notices and
from all of the benchmark table's passages, half of whose distinct paragraphs are kept back.  Its threshold is calibrated: a
family must be more probable than for nearly all held-out background paragraphs.  A paragraph that
passes is then compared with the family's templates; enough of a template's word pairs, or of its own,
must be shared for the prediction to be confirmed.

Words are hashed to numbers and n-grams worked out from those.  The n-grams that two training
rows or more have keep a slot with their weights; all others weigh nothing, so a paragraph's
probability is a sum over its filled slots.  Everything runs on built-in functions and Spark's own
learner.  Each paragraph of each text is scored where it is read; nothing is shuffled.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import stored
from palimpsest.llm.license_texts import AROUND, NAMES, TEMPLATES, UNKNOWN

FAMILIES = ("unknown", *TEMPLATES)
#: Slots for n-grams, a prime; training rows that an n-gram must stand in; hashes of single words.
SLOTS = 65521
MIN_ROWS = 2
WORD_HASHES = 1 << 20
#: Comment marks at either end of a line, and line ends within a sentence.
_MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--)(?=[ \t\r\n]|$)|[ \t]*(?:\*+/|-->)[ \t\r]*$"
_GOES_ON = r"\n(?<=[\p{L}\p{N},;:()/-][ \t\r]{0,4}\n)[ \t]*(?=\S)"
#: Share of held-out background paragraphs that may reach the threshold, and its least value.
FALSE_SHARE = 0.001
LEAST = 0.8
#: Word pairs shared with a template, as a share of the template's or of the paragraph's own.
CONFIRM = 0.6


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _pairs(tokens: Column) -> Column:
    last = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, last), F.slice(tokens, 2, last), lambda a, b: F.concat(a, F.lit(" "), b))


def _paragraphs(text: Column) -> Column:
    """Paragraphs of a text, as an array; blank ones stay, so that numbers tell their places."""
    return F.split(F.regexp_replace(F.regexp_replace(text, _MARKS, ""), _GOES_ON, " "), "\n")


def _rows(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A few literal rows, without a Python worker."""
    made = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names, strict=True))) for r in rows))
    return spark.range(1).select(F.inline(made))


def _templates(spark: SparkSession) -> list[tuple[str, list[str]]]:
    """Family and distinct word pairs of every template."""
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    rows += [(f, n) for f, ns in NAMES.items() for n in ns]
    made = _rows(spark, rows, ("family", "text"))
    return [tuple(r) for r in made.select("family", F.array_distinct(_pairs(_tokens(F.col("text"))))).collect()]


def _slots(rows: DataFrame, *keep: str) -> DataFrame:
    """``rows(tokens)`` with ``slots``: the distinct slots of one-, two- and three-word sequences."""
    hashed = F.transform("tokens", lambda w: F.xxhash64(w).bitwiseAND(F.lit(WORD_HASHES - 1)) + 1)
    made = rows.select(*keep, "tokens", hashed.alias("a"))
    later = {k: F.slice("a", k, F.greatest(F.size("a") - (k - 1), F.lit(0))) for k in (2, 3)}
    made = made.select("*", later[2].alias("b"), later[3].alias("c"))
    follow = 2 * WORD_HASHES
    twos = F.zip_with(F.slice("a", 1, F.size("b")), "b", lambda x, y: x * follow + y)
    made = made.select(*keep, "tokens", "a", "c", twos.alias("twos"))
    threes = F.zip_with(F.slice("twos", 1, F.size("c")), "c", lambda x, y: x * follow + y)
    slots = F.transform(F.concat("a", "twos", threes), lambda g: (g % F.lit(SLOTS)).cast("int"))
    return made.select(*keep, "tokens", F.array_distinct(slots).alias("slots"))


@dataclass
class Scanner:
    """Weights of the families by filled slot, their intercepts, and the least probability to report."""

    weights: dict[int, list[float]]
    intercepts: list[float]
    threshold: float


def _examples(spark: SparkSession, background: DataFrame) -> DataFrame:
    """``label, tokens, fold``: fold 0 of the background is for calibration."""
    rows = [(float(k), s) for k, family in enumerate(FAMILIES) for s in TEMPLATES.get(family, UNKNOWN)]
    base = _rows(spark, rows, ("label", "text")).select("label", _tokens(F.col("text")).alias("tokens"))
    named = [(float(FAMILIES.index(f)), a.format(n)) for f, ns in NAMES.items() for n in ns for a in AROUND]
    named = _rows(spark, named, ("label", "text")).select("label", _tokens(F.col("text")).alias("tokens"))
    parts = background.select(F.explode(_paragraphs(F.col("text"))).alias("text")).select(_tokens(F.col("text")).alias("tokens"))
    parts = stored(parts.where(F.size("tokens") > 0).distinct(), "license-background")
    other = parts.select(
        F.lit(0.0).alias("label"), "tokens", F.pmod(F.xxhash64("tokens"), F.lit(2)).cast("int").alias("fold")
    )
    # Each notice whole, with every fourth word left out (four ways), and amid ten words of another.
    thinned = base.select("label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.filter(
        "tokens", lambda _, i: (i + k) % 4 != 0))).alias("tokens"))
    thinned = thinned.where(F.size("tokens") >= 5)
    filler = [w for s in UNKNOWN for w in s.lower().replace(".", "").replace(",", "").split()]
    amid = base.select("label", F.concat(
        F.array(*(F.lit(w) for w in filler[:10])), "tokens", F.array(*(F.lit(w) for w in filler[-10:]))).alias("tokens"))
    # Notices with their words in the order of a hash name no licence any more.
    mixed = base.where("label > 0").select(
        F.lit(0.0).alias("label"),
        F.transform(F.array_sort(F.transform("tokens", lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), lambda s: s.w).alias("tokens"),
    )
    known = base.union(base).union(named).union(named).union(thinned).union(amid).union(mixed.where(F.size("tokens") >= 8))
    return known.withColumn("fold", F.lit(1)).unionByName(other.select("label", "tokens", "fold"))


def trained(spark: SparkSession, background: DataFrame) -> Scanner:
    """A scanner; ``background`` has a ``text`` without licences (null and empty ones are left out)."""
    rows = stored(_slots(_examples(spark, background), "label", "fold").withColumn("grams", F.col("slots").cast("array<string>")), "license-examples")
    known = rows.where("fold = 1")
    counter = CountVectorizer(inputCol="grams", outputCol="x", vocabSize=SLOTS, minDF=MIN_ROWS, binary=True).fit(known)
    learner = LogisticRegression(
        featuresCol="x", labelCol="label", family="multinomial", regParam=3e-4, maxIter=100, standardization=False,
        probabilityCol="p", rawPredictionCol="raw", predictionCol="y",
    )
    model = learner.fit(counter.transform(known))
    weights = dict(zip(map(int, counter.vocabulary), model.coefficientMatrix.toArray().T.tolist(), strict=True))
    scanner = Scanner(weights, model.interceptVector.toArray().tolist(), LEAST)
    held = _probable(rows.where("fold = 0"), scanner)
    reached = held.agg(F.percentile_approx("probability", 1 - FALSE_SHARE, F.lit(10000))).first()[0]
    scanner.threshold = max(LEAST, reached or 0.0)
    return scanner


def _probable(rows: DataFrame, scanner: Scanner) -> DataFrame:
    """Adds ``best(p, k)`` of the families and its ``probability`` to ``rows(slots)``."""
    listed = json.dumps([scanner.weights.get(i) for i in range(SLOTS)])
    weights = F.from_json(F.lit(listed), "array<array<double>>")
    filled = F.filter("slots", lambda i: F.get(weights, i).isNotNull())
    start = F.array(*(F.lit(float(x)) for x in scanner.intercepts))
    sums = F.aggregate("filled", start, lambda m, i: F.zip_with(m, F.get(weights, i), lambda x, y: x + y))
    keep = [c for c in rows.columns if c not in ("slots", "grams")]
    made = rows.select(*keep, filled.alias("filled")).select(*keep, sums.alias("m"))
    made = made.select(*keep, "m", F.array_max("m").alias("top"))
    made = made.select(*keep, F.transform("m", lambda x: F.exp(x - F.col("top"))).alias("e"))
    made = made.select(*keep, "e", F.aggregate("e", F.lit(0.0), lambda s, x: s + x).alias("whole"))
    named = F.transform(F.slice("e", 2, len(FAMILIES) - 1), lambda x, k: F.struct((x / F.col("whole")).alias("p"), (k + 1).alias("k")))
    return made.select(*keep, F.array_max(named).alias("best")).withColumn("probability", F.col("best.p"))


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """One row per paragraph that the classifier gives to a family.

    ``doc_id, paragraph`` (its number in the text, blank ones counted), ``family, probability,
    similarity`` (the larger shared share over the family's templates) and ``confirmed``.  Null and
    blank texts have no paragraphs; repeated rows and paragraphs are reported one by one.  Other
    columns are ignored.
    """
    known = _templates(docs.sparkSession)
    parts = docs.select("doc_id", F.posexplode_outer(_paragraphs(F.col("text"))).alias("paragraph", "part"))
    rows = parts.where("part is not null").select("doc_id", "paragraph", _tokens(F.col("part")).alias("tokens"))
    found = _probable(_slots(rows, "doc_id", "paragraph"), scanner)
    # Spark would push the filter below the classifier and run that again for each use of the
    # number it tests; the outer explode of one element keeps it above.
    one = F.explode_outer(F.array(F.struct("tokens", "best", "probability"))).alias("one")
    found = found.select("doc_id", "paragraph", one).where(F.col("one.probability") >= scanner.threshold)
    found = found.select("doc_id", "paragraph", "one.*").where(F.size("tokens") > 0)
    pairs = found.withColumn("own", F.array_distinct(_pairs(F.col("tokens"))))
    # A family's templates as arrays of word pairs; few texts, so they travel as literals.
    similar = F.lit(0.0)
    for k, family in enumerate(FAMILIES[1:], 1):
        best = F.lit(0.0)
        for name, given in known:
            if name == family:
                both = F.size(F.array_intersect("own", F.array(*(F.lit(w) for w in given))))
                best = F.greatest(best, both / max(len(given), 1), both / F.greatest(F.size("own"), F.lit(4)))
        similar = F.when(F.col("best.k") == k, best).otherwise(similar)
    named = F.element_at(F.array(*(F.lit(f) for f in FAMILIES)), F.col("best.k") + 1)
    return pairs.select(
        "doc_id", "paragraph", named.alias("family"), "probability", similar.alias("similarity"),
        (similar >= CONFIRM).alias("confirmed"),
    )
