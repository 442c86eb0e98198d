"""Batch generation with a user-supplied function, and what is done with the replies.

The function is the only place where Python sees data: Arrow carries the prompt column to
it and the replies back, all other columns stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import text as X
from palimpsest.sources.tables import require_columns

BatchFn = Callable[[list[str]], list[str]]
REPLY = T.StructType([T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])


def _answer(fn: BatchFn, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """Replies with errors caught; a failing batch is retried row by row."""
    try:
        replies = list(fn(prompts))
        if len(replies) != len(prompts):
            raise ValueError(f"{len(replies)} replies for {len(prompts)} prompts")
        return [(r, None) for r in replies]
    except Exception as e:
        if len(prompts) == 1:
            return [(None, str(e))]
        return [_answer(fn, [p])[0] for p in prompts]


def _replies_udf(make_fn: Callable[[], BatchFn], batch_size: int):
    @F.pandas_udf(REPLY)
    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = make_fn()  # once per task: load the model here
        for prompts in batches:
            todo = prompts.dropna()
            out = pd.DataFrame({"response": None, "error": None}, index=prompts.index, dtype=object)
            for i in range(0, len(todo), batch_size):
                part = todo.iloc[i : i + batch_size]
                done = _answer(fn, part.tolist())
                out.loc[part.index, "response"] = [r for r, _ in done]
                out.loc[part.index, "error"] = [e for _, e in done]
            yield out.reset_index(drop=True)

    # Replies may differ between calls, so Spark must not evaluate the call twice.
    return replies.asNondeterministic()


def generate(
    df: DataFrame,
    prompt_col: str,
    make_fn: Callable[[], BatchFn],
    num_samples: int = 1,
    batch_size: int = 10,
    partitions: int | None = None,
    key: str | None = None,
) -> DataFrame:
    """``num_samples`` replies per prompt: adds ``sample`` (from 1), ``response``, ``error``.

    ``make_fn`` returns the batch function and runs once per task.  Prompts are few and
    costly, so with ``partitions`` the samples are spread evenly by (``key``, sample).
    """
    samples = df.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(num_samples))))
    if partitions:
        samples = samples.repartition(partitions, F.col(key or prompt_col), "sample")
    reply = _replies_udf(make_fn, batch_size)(F.col(prompt_col))
    return samples.withColumn("_reply", reply).select(
        *samples.columns, F.col("_reply.response").alias("response"), F.col("_reply.error").alias("error")
    )


def generate_wide(
    df: DataFrame, prompt_col: str, make_fn: Callable[[], BatchFn], num_samples: int, batch_size: int = 10
) -> DataFrame:
    """Add ``response_1..n``: the samples of every row, from one function call per task.

    A sample that fails, and every sample of a null prompt, is null.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = make_fn()
        for prompts in batches:
            todo = prompts.dropna()
            made: dict[int, list[str | None]] = {i: [] for i in todo.index}
            for _ in range(num_samples):
                for i in range(0, len(todo), batch_size):
                    part = todo.iloc[i : i + batch_size]
                    for at, (reply, _) in zip(part.index, _answer(fn, part.tolist()), strict=True):
                        made[at].append(reply)
            yield pd.Series([made.get(i) for i in prompts.index], dtype=object)

    answers = df.withColumn("_replies", replies.asNondeterministic()(F.col(prompt_col)))
    return answers.select(
        *df.columns, *(F.get("_replies", F.lit(i)).alias(f"response_{i + 1}") for i in range(num_samples))
    )


def widen_responses(df: DataFrame, keys: Sequence[str], num_samples: int) -> DataFrame:
    """``response_1..n`` beside the keys, one shuffle on the keys."""
    return df.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("sample") == i, F.col("response"))).alias(f"response_{i}")
            for i in range(1, num_samples + 1)
        ]
    )


def correct_columns(
    df: DataFrame, cols: Sequence[str], make_fn: Callable[[], BatchFn], batch_size: int = 10
) -> DataFrame:
    """Add ``<col>_cleaned`` for each text column.

    Null and blank cells pass through and never reach the function; a failed cell keeps
    its text.  A missing column is skipped with a warning.
    """
    missing = set(require_columns(df, cols, on_missing="warn"))
    for c in (c for c in cols if c not in missing):
        ask = F.when(~X.is_blank(F.col(c)), F.col(c))
        reply = _replies_udf(make_fn, batch_size)(ask)
        df = (
            df.withColumn("_reply", reply)
            .withColumn(f"{c}_cleaned", F.coalesce(F.col("_reply.response"), F.col(c)))
            .drop("_reply")
        )
    return df


def partial_apply(df: DataFrame, cond: Column, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``op`` to the rows that meet ``cond``; append the others as they are."""
    met = F.coalesce(cond, F.lit(False))
    return op(df.where(met)).unionByName(df.where(~met), allowMissingColumns=True)


def job_status(df: DataFrame, error: str = "error") -> DataFrame:
    """Succeeded and failed rows, counted apart."""
    failed = F.col(error).isNotNull()
    return df.agg(F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))


def token_ids(df: DataFrame, col: str, make_fn: Callable[[], Callable[[list[str]], list[list[int]]]], out: str = "tokens") -> DataFrame:
    """Token ids from a user-supplied batch tokenizer."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = make_fn()
        for texts in batches:
            yield pd.Series(list(fn(texts.fillna("").tolist())), dtype=object)

    return df.withColumn(out, tokenize(F.col(col)))


def pack_tokens(
    df: DataFrame, tokens: str, max_length: int, pad_id: int = 0, pad: bool = True
) -> DataFrame:
    """``input_ids`` cut (and with ``pad`` filled) to ``max_length``, mask and labels."""
    kept = F.slice(tokens, 1, max_length)
    fill_up = F.greatest(F.lit(max_length) - F.size(kept), F.lit(0)) if pad else F.lit(0)
    ones = F.array_repeat(F.lit(1), F.size(kept))
    packed = df.withColumns(
        {
            "input_ids": F.concat(kept, F.array_repeat(F.lit(pad_id), fill_up)),
            "attention_mask": F.concat(ones, F.array_repeat(F.lit(0), fill_up)),
        }
    )
    return packed.withColumn("labels", F.col("input_ids"))
