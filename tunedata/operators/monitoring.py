"""Metrics over training steps and workers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tunedata.operators.indexing import rank_rows, running_sums

# --- fixed values: decay factors ----------------------------------------------------
LOSS_DECAY = 0.95
ACCURACY_DECAY = 0.9
SNAPSHOT_DECAY = 0.992
# ------------------------------------------------------------------------------------


def block_length(decay: float) -> int:
    """Steps over which ``decay`` falls to about ``exp(-200)``: far from overflow and from loss of digits."""
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    return max(1, int(200 / -math.log(decay)))


def ema(
    df: DataFrame, value: str, *, step: str, by: Sequence[str], decay: float = LOSS_DECAY,
    tie: Sequence[str] = (), out: str = "ema", start: str | None = None,
) -> DataFrame:
    """Exponential moving average in step order, restarted per group, from 0 or from the group's value of ``start``.

    A run of any length is split: sums run inside blocks of consecutive steps, and the
    average at the end of each block (one row per block) is carried into the next.
    """
    by = list(by)
    length = block_length(decay)
    placed = rank_rows(df, step, by=by, tie=tie, out="_k")
    placed = placed.withColumn("_block", F.floor(F.col("_k") / length)).withColumn("_i", F.col("_k") % length)
    inside = Window.partitionBy(*by, "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    grown = (1 - decay) * F.col(value) * F.pow(F.lit(decay), -F.col("_i"))
    local = placed.withColumn("_local", F.sum(grown).over(inside) * F.pow(F.lit(decay), F.col("_i")))

    # End of each block as if started from 0, and how much of the value before survives.
    ends = local.groupBy(*by, "_block").agg(
        F.max_by("_local", "_i").alias("_end"), F.pow(F.lit(decay), F.max("_i") + 1).alias("_keep")
    )
    same = F.col("_block") == F.col("_c_block")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_c_{b.lstrip('_')}"))
    joined = local.join(_carry(ends, by), same, "left")
    result = F.col("_local") + F.coalesce(F.col("_before"), F.lit(0.0)) * F.pow(F.lit(decay), F.col("_i") + 1)
    if start is not None:
        result = result + F.col(start) * F.pow(F.lit(decay), F.col("_k") + 1)
    return joined.select(*df.columns, result.alias(out))


def _carry(ends: DataFrame, by: list[str]) -> DataFrame:
    """Average before each block, from the block ends.

    A whole block keeps about ``exp(-200)`` of what came before it, so five blocks back
    nothing is left that a double could hold.
    """
    order = Window.partitionBy(*by).orderBy("_block")
    before, weight = F.lit(0.0), F.lit(1.0)
    for back in range(1, 6):
        before = before + weight * F.coalesce(F.lag("_end", back).over(order), F.lit(0.0))
        weight = weight * F.coalesce(F.lag("_keep", back).over(order), F.lit(0.0))
    keys = [F.col(c).alias(f"_c_{c.lstrip('_')}") for c in (*by, "_block")]
    return ends.select(*keys, before.alias("_before"))


def snapshot_ema(previous: DataFrame, current: DataFrame, *, beta: float = SNAPSHOT_DECAY, key: str = "example_id", value: str = "logit") -> DataFrame:
    """``(1 - beta) * current + beta * previous`` per parameter; one that is new starts at its own value."""
    old = previous.select(key, F.col(value).alias("_old"))
    mixed = (1 - beta) * F.col(value) + beta * F.col("_old")
    return current.join(old, key, "left").select(key, F.when(F.col("_old").isNull(), F.col(value)).otherwise(mixed).alias(value))


def snapshot_average(
    snapshots: DataFrame, *, beta: float = SNAPSHOT_DECAY, every: int = 1, key: str = "example_id", value: str = "logit", step: str = "step",
) -> DataFrame:
    """The moving average of every parameter after all snapshots, as ``snapshot_ema`` would leave it step by step.

    Only every ``every``-th step counts. The average is a sum with weights that are known beforehand:
    ``(1 - beta) * beta**k`` for the snapshot with k later ones, and ``beta**k`` for a parameter's first. So all
    snapshots are one partial aggregation; their number is that of the distinct steps. A parameter that is missing
    from a snapshot after its first is an error, as it would have no average there.
    """
    due = snapshots.filter(F.col(step) % every == 0)
    steps = sorted(r[0] for r in due.select(step).distinct().collect())  # one number per snapshot
    if not steps:
        return due.select(key, F.col(value).cast("double").alias(value)).limit(0)
    later = F.create_map(*[F.lit(x) for i, s in enumerate(steps) for x in (s, len(steps) - 1 - i)])
    k = F.get(F.array(F.element_at(later, F.col(step))), F.lit(0))
    power = F.pow(F.lit(float(beta)), k)
    summed = due.groupBy(key).agg(
        F.sum((1 - beta) * power * F.col(value)).alias("_sum"), F.max_by(beta * power * F.col(value), k).alias("_first"),
        F.max(k).alias("_k"), F.count(F.lit(1)).alias("_n"))
    whole = F.assert_true(F.col("_n") == F.col("_k") + 1, F.lit("a parameter is missing from a snapshot, or is in it twice"))
    return summed.select(key, F.when(whole.isNull(), F.col("_sum") + F.col("_first")).alias(value))


REDUCTIONS = {"mean": F.avg, "max": F.max, "sum": F.sum}


def reduce_metrics(df: DataFrame, op: str = "mean", *, by: Sequence[str] = ("step", "metric"), value: str = "value") -> DataFrame:
    """Mean, maximum or sum of each metric over workers."""
    return reduce_all(df, (op,), by=by, value=value).withColumnRenamed(op, value)


def reduce_all(df: DataFrame, ops: Sequence[str], *, by: Sequence[str] = ("step", "metric"), value: str = "value") -> DataFrame:
    """Several reductions of each metric over workers in one aggregation, a column each."""
    if not set(ops) <= set(REDUCTIONS):
        raise ValueError(f"op must be one of {sorted(REDUCTIONS)}")
    return df.groupBy(*by).agg(*[REDUCTIONS[op](value).alias(op) for op in ops])


def gather(*parts: DataFrame) -> DataFrame:
    """Rows of all workers, tagged with the worker's number."""
    result = None
    for worker, part in enumerate(parts):
        tagged = part.withColumn("worker", F.lit(worker))
        result = tagged if result is None else result.unionByName(tagged)
    return result


def running_mean(df: DataFrame, value: str, *, step: str, by: Sequence[str], tie: Sequence[str] = (), out: str = "running_mean") -> DataFrame:
    """Mean of all values up to each step (of batch means, not of rows)."""
    sums = {"_sum": F.col(value).cast("double"), "_count": F.lit(1).cast("bigint")}
    summed = running_sums(df, step, sums, by=by, tie=tie)
    return summed.select(*df.columns, (F.col("_sum") / F.col("_count")).alias(out))


def prefix_metrics(df: DataFrame, phase: str | Column, metric: str = "metric") -> DataFrame:
    name = phase if isinstance(phase, Column) else F.lit(phase)
    return df.withColumn(metric, F.concat_ws("/", name, F.col(metric)))
