"""One learnable weight per example, updated from logged per-example losses.

State is a table ``(example_id, logit, m, v)``. Normalising over all examples needs only
a few whole-table sums, never a window over the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tunedata.functions.arrays import dot, sigmoid
from tunedata.operators.scalars import numbers, scalars
from tunedata.session import cut_lineage, scratch_path

# --- fixed values: start logits, scales, optimiser settings, objective modes --------
START_LOGITS = {"softmax": 0.1, "sigmoid": -1e-4, "linear": -1e-4}
LEARNING_RATE = 5e-3
BETAS = (0.9, 0.95)
EPSILON = 1e-8
CLIP_NORM = 10.0
SAFE_PLUS_WEIGHTED = -1
WEIGHTED_ONLY = -2
PLAIN_ONLY = -3
SAFE_PLUS_PLAIN = -4
SPECIAL_MODES = (SAFE_PLUS_WEIGHTED, WEIGHTED_ONLY, PLAIN_ONLY, SAFE_PLUS_PLAIN)
# ------------------------------------------------------------------------------------

ACTIVATIONS = ("softmax", "sigmoid", "linear")
SAFE_SHIFT = 300.0  # exp() of this is far from overflow in sums of any length


def _check_activation(activation: str) -> None:
    if activation not in ACTIVATIONS:
        raise ValueError(f"activation must be one of {ACTIVATIONS}, got {activation!r}")


def init_logits(ids: DataFrame, activation: str = "softmax", init: float | None = None) -> DataFrame:
    """Start state for the given example ids (``init`` applies to softmax)."""
    _check_activation(activation)
    start = init if init is not None and activation == "softmax" else START_LOGITS[activation]
    return ids.select(
        "example_id", F.lit(float(start)).alias("logit"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v")
    )


#: Width of the ranges of logits whose exponentials are summed together; far from overflow.
RANGE = 300.0


def softmax_terms(df: DataFrame, logit: str = "logit") -> dict[str, Column]:
    """``top``, ``total``, ``n`` and ``moment``: shares are ``exp(logit - top) / total``, and ``moment`` is the sum of
    ``exp(logit - top) * (logit - top)``.

    One pass: logits are summed by ranges, relative to the range's own start, and what lies two ranges
    below the greatest is nothing beside it. So three short rows come back.
    """
    z = F.col(logit).cast("double")
    ranged = df.select(z.alias("_z"), F.floor(z / RANGE).alias("_range"))
    above = F.col("_z") - F.col("_range") * RANGE
    by_range = ranged.groupBy("_range").agg(
        F.count(F.lit(1)).alias("n"), F.max("_z").alias("top"), F.sum(F.exp(above)).alias("e"), F.sum(F.exp(above) * above).alias("m"))
    summed = by_range.rollup("_range").agg(
        F.grouping("_range").alias("_all"), F.sum("n").alias("n"), F.max("top").alias("top"), F.sum("e").alias("e"), F.sum("m").alias("m"))
    rows = summed.orderBy(F.desc("_all"), F.desc_nulls_last("_range")).limit(3).collect()
    n, top = rows[0]["n"], rows[0]["top"]
    total = moment = 0.0
    for row in rows[1:]:
        if row["_range"] is not None:
            shift = row["_range"] * RANGE - top
            total += math.exp(shift) * row["e"]
            moment += math.exp(shift) * (row["m"] + row["e"] * shift)
    return {name: F.lit(value) for name, value in (("top", top), ("n", n), ("total", total), ("moment", moment))}


def to_weights(df: DataFrame, activation: str = "softmax", logit: str = "logit", out: str = "weight") -> DataFrame:
    """Logits to weights: ``N * softmax``, ``2 * sigmoid`` or the logit itself."""
    _check_activation(activation)
    if activation == "linear":
        return df.withColumn(out, F.col(logit))
    if activation == "sigmoid":
        return df.withColumn(out, 2 * sigmoid(F.col(logit)))
    terms = softmax_terms(df, logit)
    return df.withColumn(out, terms["n"] * F.exp(F.col(logit) - terms["top"]) / terms["total"])


def weighted_batch_loss(losses: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean of weight times loss per step. A loss whose example has no weight is an error."""
    missing = F.raise_error(F.lit("a loss names an example that has no weight"))
    return (
        losses.join(weights.select("example_id", "weight"), "example_id", "left")
        .groupBy("step")
        .agg(
            F.avg(F.when(F.col("weight").isNull(), missing).otherwise(F.col("weight")) * F.col("loss")).alias("weighted_loss"),
            F.avg("loss").alias("plain_loss"),
        )
    )


def decayed_lambda(start: float, decay: float, epoch: Column) -> Column:
    """Safe-loss share by epoch; the special modes do not decay."""
    if start in SPECIAL_MODES:
        return F.lit(float(start))
    return F.lit(start) - F.lit(decay) * epoch


def objective(
    df: DataFrame, mode: Column | float, *, aux_coef: float = 0.0, out: str = "objective"
) -> DataFrame:
    """Combined loss of a step from ``safe_loss``, ``weighted_loss``, ``plain_loss`` (and ``aux_loss``)."""
    mode = mode if isinstance(mode, Column) else F.lit(float(mode))
    safe, weighted, plain = F.col("safe_loss"), F.col("weighted_loss"), F.col("plain_loss")
    aux = F.col("aux_loss") * aux_coef if "aux_loss" in df.columns else F.lit(0.0)
    main = (
        F.when(mode == SAFE_PLUS_WEIGHTED, safe + weighted)
        .when(mode == WEIGHTED_ONLY, weighted)
        .when(mode == PLAIN_ONLY, plain)
        .when(mode == SAFE_PLUS_PLAIN, safe + plain)
        .otherwise(mode * safe + (1 - mode) * weighted)
    )
    return df.withColumn(out, main + aux)


def entropy(df: DataFrame, logit: str = "logit") -> DataFrame:
    """``sum(p log p)`` over all examples, with softmax shares ``p``, in one pass; null without rows."""
    terms = softmax_terms(df, logit)
    value = F.try_divide(terms["moment"], terms["total"]) - F.log(terms["total"])
    return df.sparkSession.range(1).select(value.cast("double").alias("neg_entropy"))


def refreshed_entropy(df: DataFrame, fresh: DataFrame, logit: str = "logit") -> DataFrame:
    """The same with the logits of a batch replaced by freshly scored ones."""
    newer = fresh.select("example_id", F.col(logit).alias("_fresh"))
    joined = df.join(newer, "example_id", "left")
    return entropy(joined.withColumn(logit, F.coalesce(F.col("_fresh"), F.col(logit))), logit)


def mass_prior(
    df: DataFrame, n: int | Column, ratio: float, sigma: float = 0.1, *, negate: bool = False
) -> DataFrame:
    """``exp(-(sum(w) - floor(n * ratio))**2 / (2 sigma**2))`` of a ``weight`` column.

    The value is added to a loss that is minimised, so it pushes the weight mass away
    from the expected count; ``negate`` flips the sign.
    """
    expected = F.floor((n if isinstance(n, Column) else F.lit(n)) * F.lit(ratio))
    sign = -1.0 if negate else 1.0
    total = df.agg(F.sum("weight").alias("mass"))
    return total.select(
        "mass",
        (F.lit(sign) * F.exp(-F.pow(F.col("mass") - expected, F.lit(2.0)) / (2 * sigma**2))).alias("prior"),
    )


def gaussian_prior(df: DataFrame, mu: float, sigma: float, logit: str = "logit") -> DataFrame:
    """Negative log-likelihood of the logits under a normal prior."""
    term = 0.5 * F.pow((F.col(logit) - mu) / sigma, F.lit(2.0)) + math.log(sigma * math.sqrt(2 * math.pi))
    return df.agg(F.sum(term).alias("penalty"))


@dataclass(frozen=True)
class UpdateConfig:
    activation: str = "softmax"
    lr: float = LEARNING_RATE
    betas: tuple[float, float] = BETAS
    eps: float = EPSILON
    clip: float = CLIP_NORM
    entropy: float = 0.0
    gauss: float = 0.0
    gauss_mu: float = 0.0
    gauss_sigma: float = 1.0
    mass: float = 0.0
    mass_ratio: float = 1.0
    mass_sigma: float = 0.1
    mass_n: int | None = None


def _weighed(cfg: UpdateConfig) -> tuple[Column, Column]:
    """Weight and its derivative by the logit, where each weight depends on its own logit alone."""
    z = F.col("logit")
    if cfg.activation == "sigmoid":
        s = sigmoid(z)
        return 2 * s, 2 * s * (1 - s)
    return z, F.lit(1.0)


def _sums(cfg: UpdateConfig, shift: Column | float) -> dict[str, Column]:
    """The aggregates of a step, with ``exp(logit - shift)`` for the softmax parts."""
    e = F.exp(F.col("logit") - shift)
    sums = {
        "top": F.max("logit"),
        "n": F.count(F.lit(1)).cast("double"),
        "rows": F.greatest(F.sum("batch_rows"), F.lit(1)).cast("double"),
        "total": F.sum(e),
        "hit": F.sum(e * F.col("batch_loss")),
        "moment": F.sum(e * (F.col("logit") - shift)),
    }
    if cfg.mass and cfg.activation != "softmax":  # the mass is fixed under softmax
        sums["mass"] = F.sum(_weighed(cfg)[0])
    return sums


def _batch_sums(df: DataFrame, shift: float | None, cfg: UpdateConfig = UpdateConfig()) -> dict[str, float]:
    """Whole-table sums of a step.

    Any shift near the largest logit does; the one of the step before saves a pass. If the
    largest logit has moved far from it, the sums are made again with the right one.
    """
    if shift is None:
        shift = numbers(df, top=F.max("logit"))["top"]
    sums = numbers(df, **_sums(cfg, shift))
    if abs(sums["top"] - shift) > SAFE_SHIFT:
        return _batch_sums(df, sums["top"], cfg)
    return {**sums, "shift": shift}


def _gradient(cfg: UpdateConfig, sums: dict[str, Column]) -> Column:
    """Derivative of the weighted batch loss and the chosen priors by each logit.

    For the state with ``batch_loss`` (sum over the example's rows in the batch, 0 outside) and
    ``batch_rows``; ``sums`` are literals, or columns where several runs are in one table.
    """
    z, loss = F.col("logit"), F.col("batch_loss")
    n, rows = sums["n"], sums["rows"]
    weight, slope = _weighed(cfg)
    if cfg.activation == "softmax":
        share = F.exp(z - sums["shift"]) / sums["total"]
        grad = n / rows * share * (loss - sums["hit"] / sums["total"])
        if cfg.entropy:
            log_total = F.log(sums["total"])
            mean_log = sums["moment"] / sums["total"] - log_total
            grad = grad + F.lit(cfg.entropy) * share * (z - sums["shift"] - log_total - mean_log)
    else:
        grad = slope * loss / rows
    if cfg.gauss:
        grad = grad + F.lit(cfg.gauss) * (z - cfg.gauss_mu) / F.lit(cfg.gauss_sigma**2)
    if "mass" in sums:
        expected = F.lit(float(cfg.mass_n)) if cfg.mass_n is not None else n
        gap = sums["mass"] - F.floor(expected * cfg.mass_ratio)
        prior = F.exp(-gap * gap / (2 * cfg.mass_sigma**2))
        grad = grad + F.lit(cfg.mass) * prior * (-gap / cfg.mass_sigma**2) * slope
    return grad


def _adam(df: DataFrame, grad: Column, norm: Column, cfg: UpdateConfig, step: int | Column, keys: tuple[str, ...] = ("example_id",)) -> DataFrame:
    """Clip by global norm, then one Adam step without weight decay."""
    b1, b2 = cfg.betas
    g = F.col("_grad") * F.least(F.lit(1.0), F.lit(cfg.clip) / (norm + 1e-6))
    m = F.lit(b1) * F.col("m") + F.lit(1 - b1) * g
    v = F.lit(b2) * F.col("v") + F.lit(1 - b2) * g * g
    moved = df.withColumn("_grad", grad).select(*keys, "logit", m.alias("m"), v.alias("v"))
    power = step if isinstance(step, Column) else F.lit(step)
    rise = F.lit(cfg.lr) * (F.col("m") / (1 - F.pow(F.lit(b1), power)))
    return moved.select(
        *keys,
        (F.col("logit") - rise / (F.sqrt(F.col("v") / (1 - F.pow(F.lit(b2), power))) + cfg.eps)).alias("logit"),
        "m",
        "v",
    )


def _with_batch(state: DataFrame, losses: DataFrame, keys: tuple[str, ...] = ("example_id",)) -> DataFrame:
    """State with the batch losses of each example; repeated ids are summed first.

    A loss whose example has no weight is an error, as it would shrink the batch unseen.
    """
    per_id = losses.groupBy(*keys).agg(
        F.sum("loss").alias("batch_loss"), F.count(F.lit(1)).alias("batch_rows")
    )
    met = state.withColumn("_known", F.lit(True)).join(per_id, list(keys), "full_outer")
    known = F.when(F.col("_known").isNull(), F.raise_error(F.lit("a loss names an example that has no weight"))).otherwise(F.col("logit"))
    return met.withColumn("logit", known).drop("_known").fillna({"batch_loss": 0.0, "batch_rows": 0})


def _one_step(
    state: DataFrame, losses: DataFrame, cfg: UpdateConfig, step: int,
    store: Callable[[DataFrame], DataFrame], shift: float | None,
) -> tuple[DataFrame, float]:
    joined = store(_with_batch(state, losses))
    sums = _batch_sums(joined, shift, cfg)
    grad = _gradient(cfg, {name: F.lit(value) for name, value in sums.items()})
    norm = scalars(joined, norm=F.sqrt(F.sum(F.pow(grad, F.lit(2.0)))))["norm"]
    return _adam(joined, grad, norm, cfg, step), sums["top"]


def update_logits(
    state: DataFrame,
    losses: DataFrame,
    cfg: UpdateConfig = UpdateConfig(),
    step: int = 1,
    *,
    store: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """State after one weight step on ``losses`` (``example_id, loss``).

    The join of state and batch is stored once, read for a few whole-table sums, and
    projected to the new state.
    """
    _check_activation(cfg.activation)
    return _one_step(state, losses, cfg, step, store, None)[0]


def run_schedule(
    state: DataFrame,
    losses: DataFrame,
    cfg: UpdateConfig = UpdateConfig(),
    *,
    steps: range,
    done_before: int = 0,
    snapshot_every: int | None = None,
    write_snapshot: Callable[[int, DataFrame], None] | None = None,
) -> DataFrame:
    """Run one weight step per number in ``steps`` over ``losses`` (``step, example_id, loss``).

    Each step depends on the one before, so this is a loop; a step is one join written to the
    shared folder and a handful of cluster-wide sums (only those numbers reach the driver).
    Two tables are written in turn, so plans stay short and a lost executor costs at most the
    running step. The log is written once by step, so each step reads its own folder.
    To go on from a snapshot, give the number of steps it has behind it as ``done_before``.
    """
    _check_activation(cfg.activation)
    spark = state.sparkSession
    log = scratch_path(spark, "losses")
    losses.select(F.col("step").cast("bigint").alias("step"), "example_id", "loss").write.partitionBy("step").parquet(log)
    logged = spark.read.schema(T.StructType([losses.schema["example_id"], losses.schema["loss"], T.StructField("step", T.LongType())])).parquet(log)
    tables = (scratch_path(spark, "state"), scratch_path(spark, "state"))
    current, shift = state, None
    for done, step in enumerate(steps, start=done_before + 1):
        batch = logged.filter(F.col("step") == step).select("example_id", "loss")
        store = partial(cut_lineage, path=tables[done % 2])
        current, shift = _one_step(current, batch, cfg, done, store, shift)
        if write_snapshot and snapshot_every and done % snapshot_every == 0:
            write_snapshot(step, current)
    return cut_lineage(current)


def _run_sums(joined: DataFrame, cfg: UpdateConfig, tops: DataFrame | None) -> DataFrame:
    """The sums of a step for each run: one short row each. ``tops``: (run, shift) of the step before."""
    if tops is None:
        tops = cut_lineage(joined.groupBy("run").agg(F.max("logit").alias("shift")))
    shifted = joined.join(F.broadcast(tops), "run")  # one row for each run
    sums = cut_lineage(shifted.groupBy("run", "shift").agg(*[value.alias(f"_{name}") for name, value in _sums(cfg, F.col("shift")).items()]))
    if not sums.filter(F.abs(F.col("_top") - F.col("shift")) > SAFE_SHIFT).isEmpty():
        return _run_sums(joined, cfg, sums.select("run", F.col("_top").alias("shift")))
    return sums


def run_schedules(
    state: DataFrame,
    losses: DataFrame,
    cfg: UpdateConfig = UpdateConfig(),
    *,
    steps: range,
    snapshot_every: int | None = None,
    write_snapshot: Callable[[int, DataFrame], None] | None = None,
) -> DataFrame:
    """``run_schedule`` for many runs in one loop, such as one for each mixture ratio.

    ``state``: (run, example_id, logit, m, v, done), ``losses``: (run, step, example_id, loss). A step joins all runs at
    once, and what a run sums up over its examples is one short row that is joined back, so the jobs are as
    many as for a single run, whatever the number of runs. ``done`` counts the steps a run has behind it: a run that
    was carried over from a snapshot goes on where it stood, and waits until the others have caught up.
    Losses of a run or example that has no weight are an error. Returns the state after all steps.
    """
    _check_activation(cfg.activation)
    keys = ("run", "example_id")
    spark = state.sparkSession
    log = scratch_path(spark, "losses")
    parts = ["run", "example_id", "loss"]
    losses.select(F.col("step").cast("bigint").alias("step"), *parts).write.partitionBy("step").parquet(log)
    logged = spark.read.schema(T.StructType([*[losses.schema[c] for c in parts], T.StructField("step", T.LongType())])).parquet(log)
    tables = (scratch_path(spark, "state"), scratch_path(spark, "state"))
    current, tops = state.select(*keys, "logit", "m", "v", F.col("done").cast("bigint").alias("done")), None
    for number, step in enumerate(steps, start=1):
        batch = logged.filter(F.col("step") == step).select(*parts)
        joined = cut_lineage(_with_batch(current, batch, keys), path=tables[number % 2])
        sums = _run_sums(joined, cfg, tops)
        with_sums = joined.join(F.broadcast(sums), "run")
        grad = _gradient(cfg, {name[1:] if name[0] == "_" else name: F.col(name) for name in sums.columns if name != "run"})
        norms = cut_lineage(with_sums.groupBy("run").agg(F.sqrt(F.sum(F.pow(grad, F.lit(2.0)))).alias("_norm")))
        moved = _adam(with_sums.join(F.broadcast(norms), "run"), grad, F.col("_norm"), cfg, number, (*keys, "done"))
        # A run that has this step behind it keeps its state.
        kept = joined.filter(F.col("done") >= number).select(*keys, "logit", "m", "v", "done")
        current = moved.filter(F.col("done") < number).withColumn("done", F.lit(number).cast("bigint")).select(*kept.columns).unionByName(kept)
        tops = sums.select("run", F.col("_top").alias("shift"))
        if write_snapshot and snapshot_every and number % snapshot_every == 0:
            write_snapshot(step, current)
    return cut_lineage(current)


def pool(df: DataFrame, how: str, *, key: str, pos: str, vector: str, last: str) -> DataFrame:
    """One vector per sequence from token vectors up to position ``last``.

    The mean is merged from one buffer of the vector's size per sequence and partition, so a long sequence is
    not gathered in one task. Vectors have one length; null ones do not count.
    """
    if how == "first":
        return df.groupBy(key).agg(F.min_by(vector, pos).alias("pooled"))
    kept = df.filter(F.col(pos) <= F.col(last))
    if how == "last":
        return kept.groupBy(key).agg(F.max_by(vector, pos).alias("pooled"))
    if how != "mean":
        raise ValueError("how must be mean, last or first")
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    dense = kept.filter(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return dense.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("pooled"))


def linear_score(df: DataFrame, vector: str, weights: Column, bias: float = 0.0, out: str = "logit") -> DataFrame:
    return df.withColumn(out, dot(F.col(vector), weights) + bias)


def activate(df: DataFrame, activation: str, *, logit: str = "logit", batch: str = "batch", out: str = "score") -> DataFrame:
    """Logits to scores; softmax is taken within a batch and scaled by the batch size."""
    _check_activation(activation)
    if activation == "linear":
        return df.withColumn(out, F.col(logit))
    if activation == "sigmoid":
        return df.withColumn(out, sigmoid(F.col(logit)))
    tops = df.groupBy(batch).agg(F.max(logit).alias("_top"))
    shifted = df.join(tops, batch)
    totals = shifted.groupBy(batch).agg(
        F.sum(F.exp(F.col(logit) - F.col("_top"))).alias("_total"), F.count(F.lit(1)).alias("_n")
    )
    return shifted.join(totals, batch).select(
        *df.columns, (F.col("_n") * F.exp(F.col(logit) - F.col("_top")) / F.col("_total")).alias(out)
    )


def score_all(df: DataFrame, vector: str, weights: Column, bias: float, activation: str, batch: str = "batch") -> DataFrame:
    """Logit and score of every row in one pass, keyed by its id."""
    return activate(linear_score(df, vector, weights, bias), activation, batch=batch)
