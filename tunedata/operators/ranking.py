"""Attach learned weights to examples, rank and split them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunedata.functions.templates import INPUT_HEAD, INSTRUCTION_HEAD, RESPONSE_HEAD, between
from tunedata.operators.indexing import rank_rows
from tunedata.operators.weights import softmax_terms

# --- fixed values -------------------------------------------------------------------
SCORE_SCALE = 1000
TASK_ANSWERS = ("positive", "negative")
# ------------------------------------------------------------------------------------


def attach_scores(
    examples: DataFrame, weights: DataFrame, *, key: str = "id", scale: float | str = SCORE_SCALE
) -> DataFrame:
    """Add ``score_logit`` and ``score_softmax`` (softmax over all weights times ``scale``, or ``"n"``).

    An example without a weight is an error, not a row less.
    """
    terms = softmax_terms(weights)
    factor = terms["n"] if scale == "n" else F.lit(scale)
    scored = weights.select(
        F.col("example_id").alias(key),
        F.col("logit").alias("score_logit"),
        (F.exp(F.col("logit") - terms["top"]) / terms["total"] * factor).alias("score_softmax"),
    )
    missing = F.raise_error(F.lit("an example has no weight"))
    met = examples.join(scored, key, "left")
    return met.withColumn("score_logit", F.when(F.col("score_logit").isNull(), missing).otherwise(F.col("score_logit")))


def untemplate(prompt: Column, source: Column) -> Column:
    """User text of a templated prompt: the input of ``ft`` rows, the instruction of ``harmful`` ones."""
    return (
        F.when(source == "ft", between(prompt, INPUT_HEAD, RESPONSE_HEAD))
        .when(source == "harmful", between(prompt, INSTRUCTION_HEAD, RESPONSE_HEAD))
        .otherwise(prompt)
    )


def sort_by_score(df: DataFrame, score: str = "score_softmax", key: str = "id") -> DataFrame:
    """Highest score first, in id order on ties (a range-partitioned sort)."""
    return df.orderBy(F.desc(score), F.asc(key))


def rank_by_score(df: DataFrame, score: str = "score_softmax", key: str = "id", out: str = "rank") -> DataFrame:
    """Add the position in that order without a global window."""
    negated = df.withColumn("_neg", -F.col(score))
    return rank_rows(negated, "_neg", tie=[key], out=out).drop("_neg")


def ranked_splits(
    df: DataFrame, *, by: str = "source", answers: tuple[str, ...] = TASK_ANSWERS, response: str = "response"
) -> dict[str, DataFrame]:
    """``ft`` and ``harmful`` parts of ranked examples.

    ``by="response"`` picks ``ft`` by its answers, which only a two-class task allows.
    """
    if by not in ("source", "response"):
        raise ValueError("by must be source or response")
    ft = F.col(response).isin(*answers) if by == "response" else F.col("source") == "ft"
    return {"ft": df.filter(ft), "harmful": df.filter(F.col("source") == "harmful")}
