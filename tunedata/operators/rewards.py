"""Reward post-processing of generated answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tunedata.functions.templates import REWARD_TEMPLATE
from tunedata.operators.scalars import scalars


def zscore(df: DataFrame, value: str = "reward", out: str | None = None) -> DataFrame:
    """Centre and scale by the sample standard deviation of the whole table."""
    stats = scalars(df, mean=F.avg(value), std=F.stddev_samp(value))
    return df.withColumn(out or value, F.try_divide(F.col(value) - stats["mean"], stats["std"]))


def reward_text(reward: Column) -> Column:
    """Two decimals of the exact value; exact halves go to the even digit."""
    return F.replace(F.format_number(reward.cast("double"), 2), F.lit(","), F.lit(""))


def condition_on_reward(df: DataFrame, template: str = REWARD_TEMPLATE, *, normalise: bool = False) -> DataFrame:
    """Put the reward into the input text. The reward is filled in before the input."""
    for slot in ("{input}", "{reward}"):
        if slot not in template:
            raise ValueError(f"template lacks {slot}")
    scored = zscore(df) if normalise else df
    filled = F.replace(F.lit(template), F.lit("{reward}"), reward_text(F.col("reward")))
    return scored.withColumn("input", F.replace(filled, F.lit("{input}"), F.col("input")))


def best_of_n(
    df: DataFrame, key: str = "input", score: str = "reward", pos: str = "pos", output: str = "output"
) -> DataFrame:
    """Best answer per input, the earliest on ties; ``first_pos`` gives the order of inputs.

    NaN never beats a number, but stays if the first answer has it. The same plan serves batch
    tables and streams.
    """
    value = F.col(score).cast("double")
    first_nan = F.min_by(F.isnan(value), pos)
    order = F.struct(F.when(F.isnan(value), F.lit(None)).otherwise(value), -F.col(pos))
    answer = F.struct(F.col(output).alias("output"), F.col(score).alias("reward"))
    grouped = df.groupBy(key).agg(
        F.max_by(answer, order).alias("_best"),
        F.min_by(answer, pos).alias("_first"),
        first_nan.alias("_stuck"),
        F.min(pos).alias("first_pos"),
    )
    pick = F.when(F.col("_stuck"), F.col("_first")).otherwise(F.col("_best"))
    return grouped.select(key, pick["output"].alias("output"), pick["reward"].alias("reward"), "first_pos")


# --- fixed values: processor names --------------------------------------------------
PROCESSORS: dict[str, Callable[..., DataFrame]] = {"rs": best_of_n, "ca": condition_on_reward}
# ------------------------------------------------------------------------------------


def get_processor(name: str) -> Callable[..., DataFrame]:
    if name not in PROCESSORS:
        raise ValueError(f"no processor named {name!r}")
    return PROCESSORS[name]
