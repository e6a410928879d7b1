"""Shards, batches, and the joins that pair rows by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tunedata.functions.permutation import permuted
from tunedata.operators.indexing import rank_rows, shuffle_rank
from tunedata.operators.scalars import row_total, scalars


def assign_shards(
    df: DataFrame, id_col: str, shards: int, *, seed: int, epoch: int = 0, drop_last: bool = False
) -> DataFrame:
    """Seeded permutation dealt out round robin, with equally many rows per shard.

    Adds ``shard`` and ``shard_pos``. Missing rows are filled by repeating the
    permutation from its start; with ``drop_last`` surplus rows are left out instead.
    """
    placed = shuffle_rank(df, id_col, seed=seed + epoch, out="_perm")
    n = row_total(df).cast("bigint")
    if drop_last:
        kept = placed.filter(F.col("_perm") < F.floor(n / F.lit(shards)) * shards)
    else:
        size = (F.ceil(n / F.lit(shards)) * shards).cast("bigint")
        repeats = F.sequence(F.col("_perm"), size - 1, n)
        kept = placed.withColumn("_perm", F.explode(repeats))
    return kept.select(
        *df.columns,
        (F.col("_perm") % shards).cast("int").alias("shard"),
        F.floor(F.col("_perm") / shards).alias("shard_pos"),
    )


def assign_shards_over(
    df: DataFrame, id_col: str, shards: int, *, seed: int, epochs: int, drop_last: bool = False
) -> DataFrame:
    """Shards of all epochs ``0 .. epochs - 1`` at once, each with a shuffle of its own.

    Adds ``epoch``, ``shard`` and ``shard_pos``. Rows are ranked by their (unique) id once; an epoch's
    place follows from rank, seed and epoch alone, so epochs add rows but no sort.
    """
    n = df.count()
    placed = rank_rows(df, id_col, out="_pos").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = placed.withColumn("_perm", permuted(F.col("_pos"), n, F.lit(seed) + F.col("epoch")))
    if drop_last:
        kept = placed.filter(F.col("_perm") < n // shards * shards)
    else:
        kept = placed.withColumn("_perm", F.explode(F.sequence(F.col("_perm"), F.lit(max(-(-n // shards) * shards - 1, 0)).cast("bigint"), F.lit(max(n, 1)).cast("bigint"))))
    return kept.select(
        *df.columns, "epoch", (F.col("_perm") % shards).cast("int").alias("shard"), F.floor(F.col("_perm") / shards).alias("shard_pos"))


def assign_batches(df: DataFrame, size: int, pos: str = "pos", out: str = "batch") -> DataFrame:
    """Consecutive micro-batches of ``size`` rows; the last one may be short."""
    return df.withColumn(out, F.floor(F.col(pos) / size))


def cyclic_zip(a: DataFrame, b: DataFrame, *, batch: str = "batch", epoch: int = 0) -> DataFrame:
    """Pair two batch sequences step by step; the shorter one starts over.

    Returns the rows of both sides with ``step`` and ``side``. An epoch is as long as
    the longer side. The repeated side goes on where the last epoch left it; if that is
    the first side, one more of its batches is used up at each end of an epoch.
    """
    last = F.coalesce(F.max(batch) + 1, F.lit(0)).cast("bigint")
    n_a, n_b = scalars(a, n=last)["n"].cast("bigint"), scalars(b, n=last)["n"].cast("bigint")
    length = F.greatest(n_a, n_b)

    def steps(own, extra: int):
        used = (F.lit(epoch) * (length + extra)).cast("bigint")
        first = F.pmod(F.col(batch) - used, own)
        repeated = F.when(first < length, F.sequence(first, length - 1, own))
        return F.explode(F.when(own < length, repeated).otherwise(F.array(F.col(batch).cast("bigint"))))

    left = a.select(steps(n_a, 1).alias("step"), F.lit("a").alias("side"), "*")
    right = b.select(steps(n_b, 0).alias("step"), F.lit("b").alias("side"), "*")
    return left.unionByName(right, allowMissingColumns=True)


def zip_epochs(
    a: DataFrame, b: DataFrame, id_col: str, size: int, *, seed: int, epochs: int
) -> DataFrame:
    """Batches of ``size`` rows of two tables, paired step by step over several epochs, in one job.

    Returns the rows of both sides with ``epoch``, ``step`` and ``side``. An epoch is one pass over the longer
    side (``b`` if they are equal), shuffled anew; the shorter one starts over whenever it ends,
    shuffled by the epoch in which it does, and goes on where the last epoch left it. If that is ``a``, one
    more of its batches is used up at each end of an epoch. Ids are unique within a side.
    """
    sizes = [a.count(), b.count()]
    batches = [-(-n // size) for n in sizes]
    short = 0 if batches[0] < batches[1] else 1
    length = max(batches)
    per_epoch = length + (1 if short == 0 else 0)
    sides = []
    for i, (df, n, own) in enumerate(zip((a, b), sizes, batches)):
        ranked = rank_rows(df.withColumn("side", F.lit("ab"[i])), id_col, out="_pos")
        passes = epochs if i != short else -(-epochs * per_epoch // own) if own else 0
        ranked = ranked.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))) if passes else F.lit(0))
        # A pass of the shorter side is shuffled by the epoch it begins in.
        begun = F.floor(F.col("_pass") * own / F.lit(per_epoch)) if i == short else F.col("_pass")
        placed = ranked.withColumn("_batch", F.floor(permuted(F.col("_pos"), n, F.lit(seed) + begun) / size))
        used = F.col("_pass") * own + F.col("_batch")
        epoch = F.floor(used / F.lit(per_epoch)) if i == short else F.col("_pass")
        step = used % F.lit(per_epoch) if i == short else F.col("_batch")
        placed = placed.withColumn("epoch", epoch.cast("int")).withColumn("step", step.cast("bigint"))
        sides.append(placed.filter((F.col("epoch") < epochs) & (F.col("step") < length)).drop("_pos", "_pass", "_batch"))
    return sides[0].unionByName(sides[1], allowMissingColumns=True)


def join_by_id(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Attach predictions, scores or weights to their rows (positional zip, by key)."""
    return left.join(right, key, "inner")


def gather_mean(values: DataFrame, members: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of ``value`` over the rows named in ``members``."""
    return values.join(members, key, "left_semi").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")
    )


def balanced_interleave(
    df: DataFrame, id_col: str, label: str, *, seed: int, epoch: int = 0, strict: bool = False
) -> DataFrame:
    """Alternate label 1 and label 0 rows, each shuffled; surplus rows are left out.

    Adds ``slot``. With ``strict`` unequal class sizes are an error.
    """
    placed = shuffle_rank(df, id_col, seed=seed + epoch, by=[label], out="_rank")
    sizes = scalars(df, pos=F.count_if(F.col(label) == 1), neg=F.count_if(F.col(label) == 0))
    if strict:
        same = F.assert_true(sizes["pos"] == sizes["neg"], F.lit("classes differ in size"))
        placed = placed.filter(same.isNull())
    return placed.filter(
        F.col(label).isin(0, 1) & (F.col("_rank") < F.least(sizes["pos"], sizes["neg"]))
    ).select(*df.columns, (2 * F.col("_rank") + (F.col(label) == 0).cast("int")).alias("slot"))


def mismatch_pairs(
    df: DataFrame, *, batch: str = "batch", pos: str = "pos", vanilla: bool = False
) -> DataFrame:
    """Add each prompt with the next row's response of its batch, under label -1.

    Batches are as small as ``assign_batches`` made them.
    """
    if vanilla:
        return df
    order = Window.partitionBy(batch).orderBy(pos)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.when(F.lead(pos).over(order).isNull(), F.first("response").over(whole)).otherwise(F.lead("response").over(order))
    other = {"response": F.col("_following"), "label": F.lit(-1).cast(df.schema["label"].dataType)}
    both = F.array(F.struct(*df.columns), F.struct(*[other.get(c, F.col(c)).alias(c) for c in df.columns]))
    return df.withColumn("_following", following).select(F.inline(both))


def unpivot_pairs(df: DataFrame) -> DataFrame:
    """A preference pair becomes two judged answers: chosen 1, rejected 0."""
    answers = F.array(
        F.struct(F.col("chosen").alias("response"), F.lit(1).alias("label")),
        F.struct(F.col("rejected").alias("response"), F.lit(0).alias("label")),
    )
    rest = [c for c in df.columns if c not in ("chosen", "rejected")]
    return df.select(*rest, F.inline(answers))


def stack_sides(df: DataFrame, chosen: str, rejected: str, out: str = "tokens") -> DataFrame:
    """Chosen and rejected sequences as rows of one column with ``side``."""
    rest = [c for c in df.columns if c not in (chosen, rejected)]
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col(chosen).alias(out)),
        F.struct(F.lit("rejected").alias("side"), F.col(rejected).alias(out)),
    )
    return df.select(*rest, F.inline(sides))


def repair_sides(df: DataFrame, key: str, value: str) -> DataFrame:
    """Bring the two sides of a pair back to one row."""
    return df.groupBy(key).agg(
        F.max(F.when(F.col("side") == "chosen", F.col(value))).alias(f"{value}_chosen"),
        F.max(F.when(F.col("side") == "rejected", F.col(value))).alias(f"{value}_rejected"),
    )


def pad_batch(
    df: DataFrame, arrays: str, batch: str = "batch", *, side: str = "left", value=0
) -> DataFrame:
    """Pad arrays to the longest one of their batch; a batch is small, so one window over it does."""
    if side not in ("left", "right"):
        raise ValueError("side must be left or right")
    widest = df.withColumn("_width", F.max(F.size(arrays)).over(Window.partitionBy(batch)))
    fill = F.array_repeat(F.lit(value).cast(df.schema[arrays].dataType.elementType), F.col("_width") - F.size(arrays))
    parts = [fill, F.col(arrays)] if side == "left" else [F.col(arrays), fill]
    return widest.withColumn(arrays, F.concat(*parts)).select(*df.columns)
