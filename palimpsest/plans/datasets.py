"""Clean transcripts to training rows, and questions to answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from palimpsest.operators import fields, generate, joins, prompts, tasks
from palimpsest.sources.tables import require_columns


def select_years(df: DataFrame, years: tuple[int, int] = fields.FORTIES, cols: Sequence[str] = ("item_number", "original_transcript")) -> tuple[DataFrame, DataFrame]:
    """(all columns, chosen columns) of the rows in a range of years."""
    kept = fields.filter_years(df, *years)
    return kept, kept.select(*cols)


def merge_variants(main: DataFrame, manual: DataFrame, key: str, cols: Sequence[str], clean: str = "clean_transcript") -> DataFrame:
    """Original, semi-clean and manually cleaned transcripts of the manually cleaned items."""
    kept = joins.restrict_to(main, manual, key).select(*cols)
    return joins.attach(kept, manual, key, [clean])


def instruction_rows(df: DataFrame, seed: int = 0, **columns: str) -> DataFrame:
    """Completion tasks with their training text."""
    return tasks.training_text(tasks.completion_tasks(df, seed=seed, **columns), template="io")


def answer_questions(
    df: DataFrame,
    make_fn: Callable[[], generate.BatchFn],
    num_samples: int = 1,
    template: str = "qa",
    keys: Sequence[str] = ("question", "answer"),
    partitions: int | None = None,
) -> DataFrame:
    """``response_1..n`` for every row; equal rows are asked one by one, and all stay.

    One call takes a row's prompt to all its samples, so nothing is shuffled unless
    ``partitions`` deals the rows out anew.
    """
    require_columns(df, keys)
    asked = prompts.build_prompts(df.select(*keys), "question", template)
    if partitions:
        asked = asked.repartition(partitions)
    return generate.generate_wide(asked, "prompt", make_fn, num_samples).select(
        *keys, *(f"response_{i}" for i in range(1, num_samples + 1))
    )
