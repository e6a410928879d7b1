"""Statistics of logged token log-probabilities.

Token tables have one row per ``(seq_id, pos)``. Everything is a grouped sum with
partial aggregation, so a sequence or batch with many rows is not gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tunedata.functions.arrays import array_softmax, clamp, let, log_sum_exp
from tunedata.operators.tokens import IGNORE_LABEL

# --- fixed values -------------------------------------------------------------------
REWARD_LIMIT = 10.0
POLICY_CLIP = 0.2
NORM_EPS = 1e-8
#: Positions of a sequence that one task looks at together.
BLOCK = 4096
# ------------------------------------------------------------------------------------


def label_logp(logits: Column, label: Column) -> Column:
    """Log-probability of the zero-based ``label`` under ``logits``."""
    return F.get(logits, label).cast("double") - log_sum_exp(logits)


def next_labels(tokens: DataFrame, seq: str = "seq_id") -> DataFrame:
    """Token rows with the label at the next position (null where there is none).

    Positions are cut into blocks, so that a sequence of any length spreads over tasks; the first
    position of a block is also sent to the block before, for the last one there. Rows without a sequence are
    one sequence. Where a position was logged twice, its least label counts, and each of its
    rows predicts what follows.
    """
    block = F.floor(F.col("pos") / BLOCK)
    where = F.when(F.col("pos") % BLOCK == 0, F.array(block, block - 1)).otherwise(F.array(block))
    following = Window.partitionBy(seq, "_block").orderBy("pos").rangeBetween(1, 1)
    met = tokens.withColumn("_block", F.explode(where)).withColumn("next_label", F.min("label").over(following))
    return met.filter(F.col("_block").eqNullSafe(block)).drop("_block")


def _token_loss(tokens: DataFrame, seq: str) -> DataFrame:
    """Loss of each position that predicts a label; ``logp`` is that label's log-probability."""
    counted = F.coalesce(F.col("next_label") != IGNORE_LABEL, F.lit(False))
    return next_labels(tokens, seq).select(
        "*", counted.cast("int").alias("_n"), F.when(counted, -F.col("logp")).otherwise(0.0).alias("_nll")
    )


def sequence_loss(tokens: DataFrame, reduce: str = "mean", seq: str = "seq_id") -> DataFrame:
    """Loss per sequence; null where no token counts."""
    if reduce not in ("mean", "sum"):
        raise ValueError("reduce must be mean or sum")
    rows = _token_loss(tokens, seq).groupBy(seq).agg(F.sum("_nll").alias("_s"), F.sum("_n").alias("n_tokens"))
    value = F.try_divide(F.col("_s"), F.col("n_tokens")) if reduce == "mean" else F.col("_s")
    return rows.select(seq, F.when(F.col("n_tokens") > 0, value).alias("loss"), "n_tokens")


def pooled_loss(tokens: DataFrame, by: list[str] | None = None, seq: str = "seq_id") -> DataFrame:
    """Mean over all tokens of a batch (not the mean of sequence means)."""
    rows = _token_loss(tokens, seq).groupBy(*(by or []))
    return rows.agg(
        F.try_divide(F.sum("_nll"), F.sum("_n")).alias("loss"), F.sum("_n").alias("n_tokens")
    )


def _masked_sums() -> tuple[Column, Column]:
    """Sum of the log-probabilities that the mask keeps, and their mean."""
    total = F.sum(F.when(F.col("mask") == 1, F.col("logp")).otherwise(0.0))
    return total, F.try_divide(total, F.sum(F.col("mask").cast("bigint")))


def sequence_logp(tokens: DataFrame, *, average: bool = False, seq: str = "seq_id") -> DataFrame:
    """Sum (or mean) of masked log-probabilities per sequence; ``mask`` leaves out the prompt."""
    total, mean = _masked_sums()
    return tokens.groupBy(seq).agg((mean if average else total).alias("logp"))


def sequence_logps(tokens: DataFrame, seq: str = "seq_id") -> DataFrame:
    """Sum (``total``) and mean (``mean``) of masked log-probabilities per sequence in one aggregation."""
    total, mean = _masked_sums()
    return tokens.groupBy(seq).agg(total.alias("total"), mean.alias("mean"))


def masked_mean(tokens: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return tokens.groupBy(*(by or [])).agg(
        F.try_divide(F.sum(F.col(value) * F.col("mask")), F.sum("mask")).alias("masked_mean")
    )


def masked_normalise(tokens: DataFrame, value: str, by: str = "seq_id", out: str = "normed") -> DataFrame:
    """Centre by the masked mean and divide by the masked standard deviation.

    Masked-out values count as zero and are centred as well.
    """
    kept = F.when(F.col("mask") == 1, F.col(value))
    stats = tokens.groupBy(by).agg(F.avg(kept).alias("_mean"), F.var_pop(kept).alias("_var"))
    scale = F.sqrt(F.greatest(F.col("_var"), F.lit(NORM_EPS)))
    return tokens.join(stats, by).select(
        *tokens.columns, ((F.col(value) * F.col("mask") - F.col("_mean")) / scale).alias(out)
    )


def approx_kl(df: DataFrame, out: str = "kl") -> DataFrame:
    return df.withColumn(out, (F.col("logp") - F.col("logp_ref")) * F.col("mask"))


def kl_reward(tokens: DataFrame, rewards: DataFrame, kl_coef: float, seq: str = "seq_id") -> DataFrame:
    """Per-token reward: KL penalty everywhere, the clamped terminal reward at the last action.

    A sequence without any action gets the terminal reward at its last position.
    """
    coef = max(kl_coef, 0.0)
    ends = tokens.groupBy(seq).agg(
        F.coalesce(F.max(F.when(F.col("mask") == 1, F.col("pos"))), F.max("pos")).alias("_end")
    )
    ends = ends.join(rewards.select(seq, F.col("reward").alias("_r")), seq, "left")
    terminal = F.when(F.col("pos") == F.col("_end"), clamp(F.col("_r"), -REWARD_LIMIT, REWARD_LIMIT)).otherwise(0.0)
    return approx_kl(tokens).join(ends, seq).select(
        *tokens.columns, "kl", (terminal - F.lit(coef) * F.col("kl")).alias("token_reward")
    )


def _two_level_mean(tokens: DataFrame, loss: Column, batch: str, seq: str) -> DataFrame:
    """Masked mean per sequence, then mean over the sequences of a batch."""
    per_seq = tokens.groupBy(batch, seq).agg(
        F.try_divide(F.sum(loss * F.col("mask")), F.sum("mask")).alias("_l")
    )
    return per_seq.groupBy(batch).agg(F.avg("_l").alias("_loss"))


def policy_objective(tokens: DataFrame, clip: float = POLICY_CLIP, batch: str = "batch", seq: str = "seq_id") -> DataFrame:
    ratio = F.exp(F.col("logp") - F.col("logp_old"))
    gain = F.least(ratio * F.col("advantage"), clamp(ratio, 1 - clip, 1 + clip) * F.col("advantage"))
    return _two_level_mean(tokens, -gain, batch, seq).withColumnRenamed("_loss", "policy_loss")


def value_objective(tokens: DataFrame, clip: float | None = None, batch: str = "batch", seq: str = "seq_id") -> DataFrame:
    value, old, target = F.col("value"), F.col("value_old"), F.col("returns")
    loss = F.pow(value - target, F.lit(2.0))
    if clip is not None:
        near = old + clamp(value - old, -clip, clip)
        loss = F.greatest(F.pow(near - target, F.lit(2.0)), loss)
    means = _two_level_mean(tokens, loss, batch, seq)
    return means.select(batch, (0.5 * F.col("_loss")).alias("value_loss"))


def distillation(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cross-entropy of ``logits`` against ``teacher_logits`` over positions with a valid label.

    Infinite student logits contribute nothing.
    """
    infinite = F.lit(float("inf"))
    teacher = array_softmax(F.col("teacher_logits"))

    def cross(total: Column) -> Column:
        terms = F.zip_with(
            "logits", teacher, lambda s, p: F.when(F.abs(s) == infinite, F.lit(0.0)).otherwise(p * (s - total))
        )
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    x = let(log_sum_exp(F.col("logits")), cross)
    valid = (F.col("label") != IGNORE_LABEL).cast("int")
    return df.groupBy(*(by or [])).agg((-F.try_divide(F.sum(x * valid), F.sum(valid))).alias("kd_loss"))


def _top_experts(logits: Column, top_k: int) -> Column:
    """Zero-based numbers of the ``top_k`` largest logits."""
    ranked = F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("neg"), i.alias("expert"))))
    return F.transform(F.slice(ranked, 1, top_k), lambda s: s["expert"])


def router_balance(df: DataFrame, num_experts: int, top_k: int = 2, *, standard: bool = False) -> DataFrame:
    """Load balance of expert routing over all tokens of all layers.

    By default the number of experts hit at all, which is what taking the maximum over the
    token axis comes to; ``standard`` gives ``E * sum(f_e * P_e)`` with the routed fraction
    ``f`` and mean probability ``P`` of each expert.
    """
    experts = F.explode(_top_experts(F.col("logits"), top_k)).alias("expert")
    if not standard:
        hit = df.select(experts).agg(F.count_distinct("expert").cast("double").alias("balance"))
        return hit
    routed = df.select(experts).groupBy("expert").agg(F.count(F.lit(1)).alias("_hits"))
    shares = df.select(F.posexplode(array_softmax(F.col("logits"))).alias("expert", "_p"))
    mean_share = shares.groupBy("expert").agg(F.avg("_p").alias("_p"), F.count(F.lit(1)).alias("_tokens"))
    return mean_share.join(routed, "expert", "left").agg(
        (F.sum(F.coalesce(F.col("_hits"), F.lit(0)) / F.col("_tokens") * F.col("_p")) * num_experts).alias("balance")
    )


def reward_readout(
    tokens: DataFrame, *, mean: float | None = None, std: float | None = None, seq: str = "seq_id"
) -> DataFrame:
    """Value at the last valid position of each sequence, z-scored if constants are given."""
    masked = F.col("mask") == 1
    at_last = F.max_by(F.when(masked, F.col("value")), F.when(masked, F.col("pos")))
    read = tokens.groupBy(seq).agg(at_last.alias("reward"))
    if mean is None or std is None:
        return read
    return read.withColumn("reward", (F.col("reward") - mean) / std)
