"""Numeric expressions on columns and arrays that do not overflow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row.

    Inside a lambda an expression is worked out for every element; a lambda's own
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softplus(x: Column) -> Column:
    """``log(1 + exp(x))``."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def neg_log_sigmoid(x: Column) -> Column:
    return softplus(-x)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def log_sum_exp(values: Column) -> Column:
    return let(
        F.array_max(values).cast("double"),
        lambda top: top + F.log(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))),
    )


def array_softmax(values: Column) -> Column:
    return let(log_sum_exp(values), lambda total: F.transform(values, lambda v: F.exp(v - total)))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))
