"""Quality rules: base counts, then robust multivariate outliers.

Texts are measured with built-in functions only.  The statistics are transformed to a vector of
five numbers whose clean values are roughly bell-shaped.  For every language and source, location
and covariance come from the minimum-covariance-determinant estimate: starting from medians and
quartile ranges, repeated steps keep the ``SUPPORT`` share of rows with the smallest distances and
estimate from those.  Rows whose Mahalanobis distance exceeds the cutoff are rejected.

A group's threshold is taken from a histogram of log distances, so steps shuffle partial sums
and bucket counts, never rows, and a source with a third of all rows costs no more than others.
Every row also counts for its language and for the whole table; groups with fewer than
``MIN_GROUP`` rows use those estimates.  Distances are scaled so that their median is that of the
chi-square distribution.  Each variance has a floor, as most texts have no symbol and no repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import stored, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
#: Share of rows that the estimate rests on, steps, and rows below which a wider group is used.
SUPPORT = 0.75
STEPS = 4
MIN_GROUP = 200
#: Squared distance beyond which a row goes: chi-square with 5 degrees of freedom, upper 1e-6.
CUTOFF = 35.9
#: Median of chi-square with 5 degrees of freedom.
MEDIAN = 4.351
#: Names of the vector and the least standard deviation of each.
VECTOR = {"v_words": 0.3, "v_length": 0.08, "v_symbols": 0.045, "v_lines": 0.13, "v_repeat": 0.16}
_BUCKETS = 32.0


def measured(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` columns and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, text.alias("_t"), words(F.col("text")).alias("_w"))
    size = F.size("_w")
    grams = F.when(size >= 3, F.transform(
        F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    )).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    names = [c for c in base.columns if c not in ("_t", "_w")]
    base = base.select(
        *names,
        size.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        grams.alias("_g"),
    )
    # Only texts with an equal pair of windows are sorted.
    placed = F.when(
        F.size(F.array_distinct("_g")) < F.size("_g"),
        F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    base = base.withColumn("_s", placed).withColumn("_n", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    twice = F.filter(
        "_s", lambda x, j: F.coalesce(
            (x.h == F.get("_s", j + 1).h) | ((j > 0) & (x.h == F.get("_s", F.greatest(j - 1, F.lit(0))).h)), F.lit(False)
        ),
    ).i
    base = base.withColumn("_p", twice)
    covered = F.array_distinct(
        F.concat("_p", F.transform("_p", lambda i: i + 1), F.transform("_p", lambda i: i + 2))
    )
    return base.select(
        *names, "n_words", "word_chars", "n_symbols", F.col("_n").alias("n_dup_lines"),
        F.when(F.col("_p").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, named as in ``VECTOR``."""
    n = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    made = (
        F.log1p("n_words"),
        F.log(chars / n),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return [m.cast("double").alias(v) for m, v in zip(made, VECTOR, strict=True)]


def _factored(got: DataFrame) -> DataFrame:
    """``c_ij`` replaced by ``w_ij``, the inverse of the lower triangle L with L L' = c.

    One projection for each number, so that every expression stays short.
    """
    d, col = len(VECTOR), F.col
    keep = [c for c in got.columns if not c.startswith("c_")]
    for i in range(d):
        for j in range(i + 1):
            left = sum((-col(f"l_{i}{k}") * col(f"l_{j}{k}") for k in range(j)), col(f"c_{i}{j}"))
            got = got.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / col(f"l_{j}{j}"))
    for i in range(d):
        got = got.withColumn(f"w_{i}{i}", 1 / col(f"l_{i}{i}"))
        for j in range(i - 1, -1, -1):
            left = sum((col(f"l_{i}{k}") * col(f"w_{k}{j}") for k in range(j, i)), F.lit(0.0))
            got = got.withColumn(f"w_{i}{j}", -left / col(f"l_{i}{i}"))
    return got.select(*keep, *(f"w_{i}{j}" for i in range(d) for j in range(i + 1)))


def distance() -> Column:
    """Squared Mahalanobis distance of a row that carries its group's ``m_*`` and ``w_*``."""
    parts = []
    for i in range(len(VECTOR)):
        y = sum((F.col(f"w_{i}{j}") * (F.col(v) - F.col(f"m_{j}")) for j, v in enumerate(list(VECTOR)[: i + 1])), F.lit(0.0))
        parts.append(y * y)
    return sum(parts, F.lit(0.0))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.level").eqNullSafe(F.col(f"{b}.level")) & F.col(f"{a}.lang").eqNullSafe(F.col(f"{b}.lang")) & F.col(
        f"{a}.source"
    ).eqNullSafe(F.col(f"{b}.source"))


def _from_moments(rows: DataFrame, extra: list[Column]) -> DataFrame:
    """Group estimates ``m_*``, ``w_*`` from the given rows, the variances not below their floors."""
    names = list(VECTOR)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    got = rows.groupBy("group").agg(
        *extra,
        *(F.avg(v).alias(f"m_{i}") for i, v in enumerate(names)),
        *(F.covar_pop(names[i], names[j]).alias(f"c_{i}{j}") for i, j in pairs),
    )
    floors = list(VECTOR.values())
    raised = {f"c_{i}{i}": F.greatest(f"c_{i}{i}", F.lit(f**2)) for i, f in enumerate(floors)}
    return got.withColumns(raised)


def estimates(stats: DataFrame, steps: int = STEPS, support: float = SUPPORT) -> DataFrame:
    """Per group: ``group(level, lang, source)``, ``n``, ``m_*``, ``w_*``.

    ``stats`` holds ``lang``, ``source`` and the vector of all rows that the base rules keep.
    Level 2 is a language and source (nulls are a value of their own), 1 a language, 0 all rows.
    """
    names, none = list(VECTOR), F.lit(None).cast("string")
    levels = F.array(
        F.struct(F.lit(2).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), none.alias("source")),
        F.struct(F.lit(0).alias("level"), none.alias("lang"), none.alias("source")),
    )
    rows = stats.select(F.explode(levels).alias("group"), *names)
    quarts = rows.groupBy("group").agg(
        F.count("*").alias("n"), *(F.percentile_approx(v, [0.25, 0.5, 0.75], F.lit(1000)).alias(f"q_{i}") for i, v in enumerate(names))
    )
    spread = [
        F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(floor)) for i, floor in enumerate(VECTOR.values())
    ]
    model = quarts.select(
        "group", "n", *(F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(len(names))),
        *((1 / spread[i] if i == j else F.lit(0.0)).alias(f"w_{i}{j}") for i in range(len(names)) for j in range(i + 1)),
    )
    model = stored(model, "mcd-start")
    bucket = F.floor(F.log(distance() + 1e-6) * _BUCKETS).alias("b")
    order = Window.partitionBy("group").orderBy("b")

    def placed(model: DataFrame) -> DataFrame:
        named = model.withColumnRenamed("group", "of")
        return rows.join(named, _same("group", "of")).select("group", "n", *names, bucket)

    def reached(placed: DataFrame, share: float) -> DataFrame:
        """Per group the first bucket up to which at least ``share`` of its rows lie."""
        seen = placed.groupBy("group", "n", "b").count().withColumn("c", F.sum("count").over(order))
        return seen.where(F.col("c") >= F.col("n") * share).groupBy("group").agg(F.min("b").alias("limit"))

    for _ in range(steps):
        near = placed(model)
        limit = stored(reached(near, support).withColumnRenamed("group", "of"), "mcd-limit")
        inside = near.join(limit, _same("group", "of")).where("b <= limit")
        model = stored(_factored(_from_moments(inside, [F.first("n").alias("n")])), "mcd-step")
    # Scale: the median distance becomes that of the chi-square distribution.
    middle = reached(placed(model), 0.5).select(F.col("group").alias("of"), "limit")
    scale = F.greatest(F.exp((F.col("limit") + 0.5) / _BUCKETS) / MEDIAN, F.lit(1.0))
    model = model.join(middle, _same("group", "of")).withColumn("scale", F.sqrt(scale))
    weights = [c for c in model.columns if c.startswith("w_")]
    return stored(model.select("group", "n", *(f"m_{i}" for i in range(len(names))), *((F.col(w) / F.col("scale")).alias(w) for w in weights)), "mcd")


def judged(stats: DataFrame, model: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """``stats`` with ``distance`` by the narrowest group of at least ``min_group`` rows.

    The estimates are joined by language and source; Spark broadcasts them while their written
    size is under its threshold.  A pair without an estimate has a null distance.
    """
    held = [c for c in model.columns if c.startswith(("m_", "w_"))]
    level, enough = F.col("group.level"), F.col("n") >= min_group
    every = model.where(level == 0).select(*held).first()  # one row of numbers for the whole table
    last = F.struct(*((F.lit(every[c]) if every else F.lit(None).cast("double")).alias(c) for c in held))
    langs = model.where((level == 1) & enough).select(F.col("group.lang").alias("l_lang"), F.struct(*held).alias("wide"))
    pairs = model.where(level == 2).select(
        F.col("group.lang").alias("g_lang"), F.col("group.source").alias("g_source"),
        F.when(enough, F.struct(*held)).alias("own"),
    )
    pairs = pairs.join(langs, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left")
    pairs = stored(pairs.select("g_lang", "g_source", F.coalesce("own", "wide", last).alias("e")), "mcd-of-pair")
    met = stats.join(
        pairs, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left"
    )
    return met.select(*stats.columns, "e.*").select(*stats.columns, distance().alias("distance"))


def verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, four counts, ``base_failed``, ``kept``, ``distance``.

    Null and blank texts have no words and fail the base rules; null languages and sources are
    groups of their own.  Rows of equal ids or texts are judged one by one, alike.  ``distance`` is
    null where the base rules fail all rows.  Other columns are ignored.
    """
    stats = stored(measured(docs, F.col("doc_id"), F.col("lang"), F.col("source")), "text-statistics")
    model = estimates(stats.where(~base_failed()).select("lang", "source", *vector()))
    found = judged(stats.select("*", *vector()), model)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), _kept(cutoff).alias("kept"), "distance",
    )


def _kept(cutoff: float) -> Column:
    # One expression over both sides of the join: a conjunct of the counts alone would be pushed
    # below it and measure every text again.
    return F.when(base_failed(), False).otherwise(F.coalesce("distance", F.lit(0.0)) <= cutoff)


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that ``verdicts`` keeps, same columns.  Texts are measured twice, not shuffled."""
    first = stored(measured(docs, F.col("lang"), F.col("source")), "text-statistics")
    model = estimates(first.where(~base_failed()).select("lang", "source", *vector()))
    again = measured(docs, F.struct("*").alias("row"), F.col("lang"), F.col("source"))
    again = again.select("row", "lang", "source", "n_words", "n_repeat_words", *vector())
    return judged(again, model).where(_kept(cutoff)).select("row.*")
