"""Audit of how far the sources of a language differ in their words.

Texts are cut by a translate table: one ``bytes.translate`` lowers the letters A-Z and blanks every
other ASCII character that is no letter, ``bytes.split`` gives the terms, and a ``Counter`` per
document their frequencies.  Bytes of characters beyond ASCII stay as they are.  Each task adds its
documents up by language and source before anything is shuffled.

A language keeps the terms of ``MIN_DOCS`` documents or more.  Every group, that is a language's
source, and the language as a whole then has a smoothed share for each kept term,
``p = 1 + floor(SCALE * (count + 1) / (N + V))``, and groups are compared by ``floor((p - q)^2 / q)``.

The comparison of two sources is a sum over all kept terms, but only counted terms are touched:
terms that neither source has weigh the same, those that one of them has depend on their count there
alone, so that a histogram of counts is enough, and only terms of both are joined.
All arithmetic is in whole numbers; counts may reach 9 * 10^13.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

MIN_DOCS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
#: Entries that a task counts before it hands them on.
HELD = 400_000

_BLANKED = bytes(range(0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_UPPER = bytes(range(0x41, 0x5B))
TABLE = bytes.maketrans(_BLANKED + _UPPER, b" " * len(_BLANKED) + _UPPER.lower())

_COUNTS = "lang string, source string, term string, n long, docs long"
_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(TABLE).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents by group and term, handed on whenever there are ``HELD``."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            # The empty term says that the group occurs.
            names = [b"", *n]
            counts = [0, *n.values()]
            seen = [0, *(docs[t] for t in n)]
            same = len(names)
            text = pa.array(names, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * same), pa.array([source] * same), text, pa.array(counts), pa.array(seen)], schema=_ARROW)
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            n, docs = held[lang, source]
            found = Counter(terms(text.as_py()))
            size += 1 - len(n)
            n.update(found)
            docs.update(found.keys())
            size += len(n)
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term in each group.

    Every group has a row for the empty term, with zeros.  Null ``lang``, ``source`` and ``text`` count as empty.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    made = rows.mapInArrow(_counted, _COUNTS)
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> Column:
    """``1 + floor(SCALE * (count + 1) / total)`` by long division in two steps, so that nothing overflows."""
    step = 10_000
    first = f"(({count} + 1) * {step}L)"
    return F.expr(f"1L + ({first} div {total}) * {SCALE // step}L + (({first} % {total}) * {SCALE // step}L) div {total}")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every group of a language and source.

    Part ``pair`` ranks the other sources of the language by the sum of differences over all kept
    terms; part ``term`` the group's ``term_ranks`` terms that stand out most from the language.
    Nulls count as empty texts and names; a document may be repeated and counts each time; a language without
    kept terms has pairs of value 0; an empty table gives no rows.  Other columns are not read.
    """
    found = stored(counts(docs), "term-counts")
    lang_term = Window.partitionBy("lang", "term")
    kept = (
        found.where("term != ''")
        .withColumns({"in_docs": F.sum("docs").over(lang_term), "in_lang": F.sum("n").over(lang_term)})
        .where(F.col("in_docs") >= min_docs)
        .select("lang", "source", "term", "n", "in_lang")
    )
    kept = stored(kept, "kept-terms")
    # Both are as small as the lists of groups and languages.
    sizes = kept.groupBy("lang", "term").agg(F.max("in_lang").alias("c")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("c").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("own_terms"))
    groups = found.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.na.fill(0, ["own_n", "own_terms", "v", "lang_n"])
    groups = groups.select(
        "lang", "source", "v", "own_terms",
        F.expr("own_n + v").alias("d"), F.expr("lang_n + v").alias("lang_d"),
        F.when(F.col("v") > 0, _share("0L", "(own_n + v)")).alias("p0"),
    )
    groups = stored(groups, "groups")
    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "d"), "q": _share("in_lang", "lang_d")})
    shares = stored(shares.select("lang", "source", "term", "n", "p", "q", "p0"), "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    standing = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    standing = standing.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= term_ranks)

    pairs = _pair_sums(shares, groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(standing)


def _pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, other, value)`` for all ordered pairs of a language's sources.

    The sum over all terms is taken as: all terms as if neither source had them, the change for each
    source's own terms as if the other lacked them, and the change for terms of both.
    """
    left = groups.select("lang", "source", "v", "own_terms", F.col("p0").alias("a0"))
    right = groups.select("lang", F.col("source").alias("other"), F.col("own_terms").alias("other_terms"), F.col("p0").alias("b0"))
    pairs = left.join(right, "lang").where("source != other")
    nothing = F.when(F.col("v") > 0, (F.col("v") - F.col("own_terms") - F.col("other_terms")) * _apart("a0", "b0")).otherwise(0)
    base = pairs.select("lang", "source", "other", nothing.alias("value"))
    # How many terms of a group have the same share: sources meet these, not single terms.
    times = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    own = times.withColumnRenamed("p0", "a0").join(right, "lang").where("source != other")
    own = own.select("lang", "source", "other", (F.col("m") * _apart("p", "b0")).alias("value"))
    back = times.select("lang", F.col("source").alias("other"), F.col("p").alias("q"), "m").join(left, "lang").where("source != other")
    back = back.select("lang", "source", "other", (F.col("m") * _apart("a0", "q")).alias("value"))
    mine = shares.select("lang", "term", "source", F.col("p").alias("a"), F.col("p0").alias("a0"))
    theirs = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("b"), F.col("p0").alias("b0"))
    change = _apart("a", "b") - _apart("a", "b0") - _apart("a0", "b") + _apart("a0", "b0")
    both = mine.join(theirs, ["lang", "term"]).where("source != other").groupBy("lang", "source", "other").agg(F.sum(change).alias("value"))
    parts = base.unionByName(own).unionByName(back).unionByName(both)
    return parts.groupBy("lang", "source", "other").agg(F.sum("value").cast("long").alias("value"))
