"""Whole-table aggregates as constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def numbers(df: DataFrame, **aggregates: Column) -> dict[str, float]:
    """Aggregates of the whole table: one job with partial aggregation, one row to the driver."""
    return df.agg(*[value.alias(name) for name, value in aggregates.items()]).first().asDict()


def scalars(df: DataFrame, **aggregates: Column) -> dict[str, Column]:
    """The same as literals.

    Literals keep plans small where a value is used several times or feeds another
    aggregate, which would repeat a sub-query's plan at every use.
    """
    return {name: F.lit(value) for name, value in numbers(df, **aggregates).items()}


def row_total(df: DataFrame) -> Column:
    return F.lit(df.count())
