"""Task accuracy of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunedata.functions.answers import extract_number, normalise_answer
from tunedata.functions.templates import strip_echo
from tunedata.operators.tasks import ANSWER_MARK

__all__ = ["strip_echo", "matches_forms", "numeric_match", "exact_match", "accuracy", "prediction_count", "win_rate"]


def matches_forms(prediction: Column, label: Column, forms: tuple[tuple[str, str], ...]) -> Column:
    """Whether the prediction is one of the two spellings of its class.

    Labels without own spellings use those of the last class.
    """
    result = None
    for number, pair in enumerate(forms[:-1]):
        hit = prediction.isin(*pair)
        result = F.when(label == number, hit) if result is None else result.when(label == number, hit)
    return F.coalesce(result.otherwise(prediction.isin(*forms[-1])), F.lit(False))


def numeric_match(
    df: DataFrame, expected: str, predicted: str, *, marker: str = ANSWER_MARK, count_missing: bool = True
) -> DataFrame:
    """Add ``expected_number``, ``predicted_number`` and ``correct``.

    Two answers without any number are equal (both infinite) unless ``count_missing`` is off.
    """
    out = df.withColumn("expected_number", extract_number(F.col(expected), marker)).withColumn(
        "predicted_number", extract_number(F.col(predicted), marker)
    )
    same = F.col("expected_number") == F.col("predicted_number")
    if not count_missing:
        same = same & (F.col("expected_number") != float("inf"))
    return out.withColumn("correct", same)


def exact_match(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    return df.withColumn("correct", normalise_answer(F.col(expected)) == normalise_answer(F.col(predicted)))


def accuracy(df: DataFrame, by: list[str] | None = None, correct: str = "correct") -> DataFrame:
    """Rows, right answers and score in percent."""
    right = F.count_if(F.col(correct))
    total = F.count(F.lit(1))
    return df.groupBy(*(by or [])).agg(
        total.alias("n"), right.alias("n_correct"), (100 * F.try_divide(right, total)).alias("score_pct")
    )


def prediction_count(df: DataFrame, generator: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("generator", F.lit(generator))


def win_rate(verdicts: DataFrame, model: str = "model", outcome: str = "outcome") -> DataFrame:
    """Wins, losses and ties per model."""
    names = ["win", "lose", "tie"]
    return verdicts.groupBy(model).pivot(outcome, names).count().fillna(0, names)
