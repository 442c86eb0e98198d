"""Training rows from transcripts: completion tasks, training texts, word chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.arrays import indexes
from palimpsest.functions.draws import uniform_int
from palimpsest.functions.text import strip, tokens

# ---------------------------------------------------------------------------------------
# Wording of the tasks and training texts, and the section limits.
# ---------------------------------------------------------------------------------------
MIDDLE_INPUT = (
    'Fill in the missing information from the transcript for "{title}":\n'
    "{first}... [this text is missing]... {final}"
)
MIDDLE_OUTPUT = 'This is the missing text from the transcript for "{title}":\n\n{middle}'
HALF_INPUT = 'Fill in the first half of the missing transcript for "{title}":\n...{second}'
HALF_OUTPUT = 'Here is the rest of the missing text from the transcript for "{title}":\n\n{first}'
FULL_INPUT = 'Give the complete transcript for "{title}".'
FULL_OUTPUT = 'This is the complete transcript for "{title}":\n\n{transcript}'
CONTEXT_INPUT = (
    'Based on the year, {year}, and title, "{title}", complete this transcript:\n{first}...'
)
CONTEXT_OUTPUT = "Here is the rest of the missing text...\n\n{second}"
TITLE_TRAINING = "### TITLE: {title}\n### TRANSCRIPT:\n{transcript}\n### RESPONSE: {transcript}"
TASK_TRAINING = "### INPUT:{input}\n### RESPONSE: {output}"
CHUNK_WORDS = 500


@dataclass(frozen=True)
class Sections:
    min_section_words: int = 5
    min_full_length: int = 20
    first: tuple[float, float] = (0.20, 0.35)
    middle_max: float = 0.50
    half: tuple[float, float] = (0.40, 0.55)
    context: tuple[float, float] = (0.45, 0.55)


# ---------------------------------------------------------------------------------------


def fill(template: str, **cols: Column) -> Column:
    """``concat`` of a template's literal parts and the columns named in braces."""
    parts: list[Column] = []
    rest = template
    while rest:
        literal, brace, tail = rest.partition("{")
        if literal:
            parts.append(F.lit(literal))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(cols[name])
    return F.concat(*parts)


def _share(n: Column, ratio: float) -> Column:
    return F.floor(n * F.lit(ratio)).cast("int")


def _planned(
    df: DataFrame, key: str, title: str, text: str, year: str, seed: int, s: Sections
) -> DataFrame:
    """Words, draw bounds, draws and the skip reason of each document."""
    n, m = F.col("n"), s.min_section_words
    base = df.select(
        F.col(key).alias("original_index"),
        F.coalesce(F.col(title).cast("string"), F.lit("")).alias("title"),
        F.coalesce(F.col(year).cast("string"), F.lit("")).alias("year"),
        strip(F.col(text)).alias("transcript"),
    ).withColumn("words", tokens(F.col("transcript")))
    sized = base.withColumn("n", F.coalesce(F.size("words"), F.lit(-1)))
    bounds = sized.withColumns(
        {
            "first_lo": F.greatest(F.lit(m), _share(n, s.first[0])),
            "first_hi": F.least(_share(n, s.first[1]), n - 2 * m),
            "half_lo": F.greatest(F.lit(m), _share(n, s.half[0])),
            "half_hi": F.least(n - m, _share(n, s.half[1])),
            "ctx_lo": F.greatest(F.lit(m), _share(n, s.context[0])),
            "ctx_hi": F.least(n - m, _share(n, s.context[1])),
        }
    )

    def draw(lo: Column, hi: Column, task: str) -> Column:
        return uniform_int(lo, F.greatest(lo, hi), seed, task, F.col("original_index"))

    drawn = bounds.withColumns(
        {
            "first_end": draw(F.col("first_lo"), F.col("first_hi"), "first"),
            "half_split": draw(F.col("half_lo"), F.col("half_hi"), "half"),
            "ctx_split": draw(F.col("ctx_lo"), F.col("ctx_hi"), "context"),
        }
    ).withColumn(
        "middle_hi", F.least(_share(n, s.middle_max), n - F.col("first_end") - m)
    )
    return drawn.withColumns(
        {
            "middle_end": F.col("first_end") + draw(F.lit(m), F.col("middle_hi"), "middle"),
            "skip_reason": F.when(F.col("transcript").isNull(), "no transcript")
            .when(n < s.min_full_length, "too short")
            .when(F.col("first_hi") <= F.col("first_lo"), "no valid middle section")
            .when(F.col("middle_hi") <= m, "no valid middle section"),
        }
    )


def completion_tasks(
    df: DataFrame,
    key: str = "original_index",
    title: str = "title",
    text: str = "transcript",
    year: str = "year",
    seed: int = 0,
    sections: Sections = Sections(),
) -> DataFrame:
    """Up to four ``(original_index, input, output, task_type)`` rows per document.

    One narrow pass; cut points are drawn from a hash of seed, task and key.
    """
    m = sections.min_section_words
    docs = _planned(df, key, title, text, year, seed, sections)
    words, n = F.col("words"), F.col("n")

    def span(start: Column | int, end: Column) -> Column:
        start = F.lit(start) if isinstance(start, int) else start
        return F.concat_ws(" ", F.slice(words, start + 1, end - start))

    def task(name: str, when: Column, given: Column, wanted: Column) -> Column:
        return F.when(
            when, F.struct(given.alias("input"), wanted.alias("output"), F.lit(name).alias("task_type"))
        )

    t, y, full = F.col("title"), F.col("year"), F.col("transcript")
    first_end, middle_end = F.col("first_end"), F.col("middle_end")
    half, ctx = F.col("half_split"), F.col("ctx_split")
    halves = F.col("half_hi") >= F.col("half_lo")
    contexts = halves & (F.col("ctx_hi") >= F.col("ctx_lo"))
    rows = F.array(
        task(
            "missing_middle",
            n - middle_end >= m,
            fill(MIDDLE_INPUT, title=t, first=span(0, first_end), final=span(middle_end, n)),
            fill(MIDDLE_OUTPUT, title=t, middle=span(first_end, middle_end)),
        ),
        task(
            "complete_first_half",
            halves,
            fill(HALF_INPUT, title=t, second=span(half, n)),
            fill(HALF_OUTPUT, title=t, first=span(0, half)),
        ),
        task(
            "complete_full",
            halves,
            fill(FULL_INPUT, title=t),
            fill(FULL_OUTPUT, title=t, transcript=full),
        ),
        task(
            "contextual_completion",
            contexts,
            fill(CONTEXT_INPUT, year=y, title=t, first=span(0, ctx)),
            fill(CONTEXT_OUTPUT, second=span(ctx, n)),
        ),
    )
    # No filter on the skip reason: pushed down, it would repeat the word split per use.
    kept = F.when(F.col("skip_reason").isNull(), F.array_compact(rows))
    return docs.select("original_index", F.inline(kept))


def skipped_documents(
    df: DataFrame,
    key: str = "original_index",
    title: str = "title",
    text: str = "transcript",
    year: str = "year",
    seed: int = 0,
    sections: Sections = Sections(),
) -> DataFrame:
    """Documents without tasks: ``(original_index, n_words, skip_reason)``."""
    plan = _planned(df, key, title, text, year, seed, sections)
    row = F.struct(F.greatest("n", F.lit(0)).alias("n_words"), "skip_reason")
    skipped = F.when(F.col("skip_reason").isNotNull(), F.array(row))
    return plan.select("original_index", F.inline(skipped))


def training_text(df: DataFrame, template: str = "title", out: str = "text") -> DataFrame:
    """``title``: from title and transcript.  ``io``: from input and output."""
    if template == "title":
        text = fill(TITLE_TRAINING, title=F.col("title"), transcript=F.col("transcript"))
    elif template == "io":
        text = fill(TASK_TRAINING, input=F.col("input"), output=F.col("output"))
    else:
        raise ValueError(f"unknown template: {template}")
    return df.withColumn(out, text)


def chunk_words(df: DataFrame, col: str, n: int = CHUNK_WORDS, out: str = "chunk") -> DataFrame:
    """Word chunks of at most ``n``, numbered from 0 in ``chunk_no``; blank text gives none."""
    words = df.withColumn("_words", tokens(F.coalesce(F.col(col), F.lit(""))))
    chunks = F.transform(
        indexes(F.ceil(F.size("_words") / n).cast("int")),
        lambda i: F.concat_ws(" ", F.slice("_words", i * n + 1, n)),
    )
    return words.select(
        *[c for c in df.columns if c != col], F.posexplode(chunks).alias("chunk_no", out)
    )


def join_chunks(df: DataFrame, key: str, pos: str = "chunk_no", col: str = "chunk", out: str = "text") -> DataFrame:
    """Chunks of each ``key`` in order, joined by a space; a group is one document."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(col).alias("c"))))
    return df.groupBy(key).agg(parts.alias("_parts")).select(
        key, F.concat_ws(" ", F.col("_parts.c")).alias(out)
    )
