"""Row predicates and ordered limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunedata.functions.templates import SPACE_CLASS

SOURCE_FLAGS = ("all", "ft", "harmful")


def word_tokens(text: Column) -> Column:
    """White-space tokens; stands in for a tokenizer where none is supplied."""
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def word_count(text: Column, max_length: int | None = None) -> Column:
    n = F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+"))
    return F.least(n, F.lit(max_length)) if max_length is not None else n


def keep_trainable(
    df: DataFrame, *, max_length: int, tokens: str = "prompt_tokens", pretrain: bool = False
) -> DataFrame:
    """Drop prompts too long to leave room for an answer, and empty prompts or answers.

    In pretraining mode nothing is dropped and the prompt length is zero.
    """
    if pretrain:
        return df.withColumn(tokens, F.lit(0))
    return df.filter(
        (F.least(F.col(tokens), F.lit(max_length)) < max_length - 2)
        & (F.length("prompt") > 0)
        & (F.length("response") > 0)
    )


def keep_unsafe(df: DataFrame, flag: str = "is_safe") -> DataFrame:
    """Rows not marked safe; a missing mark counts as unsafe."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def keep_source(df: DataFrame, flag: str, source: str = "source") -> DataFrame:
    if flag not in SOURCE_FLAGS:
        raise ValueError(f"flag must be one of {SOURCE_FLAGS}, got {flag!r}")
    return df if flag == "all" else df.filter(F.col(source) == flag)


def any_true(categories: Column) -> Column:
    """Whether any value of a boolean map is true."""
    return F.coalesce(F.exists(F.map_values(categories), lambda v: F.coalesce(v, F.lit(False))), F.lit(False))


def keep_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isin(values))


def keep_cadence(df: DataFrame, every: int, steps_per_epoch: int, step: str = "step") -> DataFrame:
    """Rows of every ``every``-th step; -1 means once per epoch and -2 never."""
    if every == -2:
        return df.filter(F.lit(False))
    return df.filter(F.col(step) % (steps_per_epoch if every == -1 else every) == 0)


def first_rows(df: DataFrame, n: int | None, *order: str, offset: int = 0) -> DataFrame:
    """The ``n`` rows after the first ``offset`` in the given order; ``None`` keeps all."""
    if n is None and not offset:
        return df
    ordered = df.orderBy(*order).offset(offset) if offset else df.orderBy(*order)
    return ordered if n is None else ordered.limit(n)
