"""Statistics of preference pairs from logged sequence log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunedata.functions.arrays import neg_log_sigmoid, sigmoid, softplus


def pairwise_logistic(df: DataFrame, by: list[str] | None = None, margin: bool = True) -> DataFrame:
    gap = F.col("chosen_reward") - F.col("rejected_reward")
    if margin:
        gap = gap - F.col("margin")
    return df.groupBy(*(by or [])).agg(F.avg(neg_log_sigmoid(gap)).alias("loss"))


def logexp(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``log(1 + exp(rejected - chosen))``; margins are not used."""
    gap = F.col("rejected_reward") - F.col("chosen_reward")
    return df.groupBy(*(by or [])).agg(F.avg(softplus(gap)).alias("loss"))


def pair_rewards(df: DataFrame, beta: float) -> DataFrame:
    return df.withColumn("chosen_reward", beta * (F.col("pol_c") - F.col("ref_c"))).withColumn(
        "rejected_reward", beta * (F.col("pol_r") - F.col("ref_r"))
    )


def _pair_loss(beta: float, smoothing: float, ipo: bool) -> Column:
    logits = (F.col("pol_c") - F.col("pol_r")) - (F.col("ref_c") - F.col("ref_r"))
    if ipo:
        return F.pow(logits - 1 / (2 * beta), F.lit(2.0))
    return neg_log_sigmoid(beta * logits) * (1 - smoothing) + neg_log_sigmoid(-beta * logits) * smoothing


def dpo(df: DataFrame, beta: float, *, label_smoothing: float = 0.0, ipo: bool = False, batch: str = "batch") -> DataFrame:
    """Loss, mean rewards and accuracy per batch."""
    return (
        pair_rewards(df, beta)
        .groupBy(batch)
        .agg(
            F.avg(_pair_loss(beta, label_smoothing, ipo)).alias("loss"),
            F.avg("chosen_reward").alias("chosen_reward"),
            F.avg("rejected_reward").alias("rejected_reward"),
            F.avg((F.col("chosen_reward") > F.col("rejected_reward")).cast("int")).alias("accuracy"),
        )
    )


def preference_accuracy(df: DataFrame, beta: float, *, batch: str = "batch", **kwargs) -> DataFrame:
    """Mean over batches of the batch accuracy and batch loss."""
    return dpo(df, beta, batch=batch, **kwargs).agg(
        F.avg("accuracy").alias("acc_mean"), F.avg("loss").alias("loss_mean")
    )


def kto_even(df: DataFrame, beta: float, batch: str = "batch") -> DataFrame:
    """Loss and mean rewards per batch of pairs; each side is compared with the other side's batch KL, at least 0."""
    chosen, rejected = F.col("pol_c") - F.col("ref_c"), F.col("pol_r") - F.col("ref_r")
    kl = df.groupBy(batch).agg(
        F.greatest(F.avg(chosen), F.lit(0.0)).alias("chosen_kl"),
        F.greatest(F.avg(rejected), F.lit(0.0)).alias("rejected_kl"),
    )
    loss_c = 1 - sigmoid(beta * (chosen - F.col("rejected_kl")))
    loss_r = 1 - sigmoid(beta * (F.col("chosen_kl") - rejected))
    return df.join(kl, batch).groupBy(batch).agg(
        ((F.avg(loss_c) + F.avg(loss_r)) / 2).alias("loss"),
        F.avg(beta * chosen).alias("chosen_reward"), F.avg(beta * rejected).alias("rejected_reward"),
    )


def kto_uneven(
    df: DataFrame, beta: float, *, desirable: float = 1.0, undesirable: float = 1.0,
    batch: str = "batch", worker: str = "worker",
) -> DataFrame:
    """Loss per batch and worker of judged answers with mismatched pairs (label -1).

    ``policy`` and ``reference`` are sequence log-probabilities. The KL estimate is the mean
    over workers of their mismatched means, at least 0. A batch may lack either class. One
    without mismatched pairs has no KL: its rows stay, with a null loss. The rewards are means
    over the batch and worker, null for a class it lacks.
    """
    ratio = F.col("policy") - F.col("reference")
    per_worker = df.filter(F.col("label") == -1).groupBy(batch, worker).agg(F.avg(ratio).alias("_kl"))
    kl = per_worker.groupBy(batch).agg(F.greatest(F.avg("_kl"), F.lit(0.0)).alias("kl"))
    good = F.lit(desirable) * (1 - sigmoid(beta * (ratio - F.col("kl"))))
    bad = F.lit(undesirable) * (1 - sigmoid(beta * (F.col("kl") - ratio)))
    judged = df.filter(F.col("label").isin(0, 1)).join(kl, batch, "left")
    return judged.groupBy(batch, worker).agg(
        F.avg(F.when(F.col("label") == 1, good).otherwise(bad)).alias("loss"), F.first("kl").alias("kl"),
        F.avg(F.when(F.col("label") == 1, beta * ratio)).alias("chosen_reward"),
        F.avg(F.when(F.col("label") == 0, beta * ratio)).alias("rejected_reward"),
    )
