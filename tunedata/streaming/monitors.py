"""Streaming forms of the monitors and of the normalising step.

Every function takes a streaming DataFrame and returns one (or starts a query that
writes). They use Spark's own state store and watermarks; run to the end of the input
they agree with their batch counterparts.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tunedata.operators.distribution import SKETCH, sketch_histogram, value_sketches
from tunedata.operators.rewards import best_of_n
from tunedata.operators.safety import decide_labels
from tunedata.session import cut_lineage
from tunedata.sources.ledger import add_batch, read_batches


def stream_group_means(
    df: DataFrame, *, ts: str, source: str, value: str, length: str = "1 day", late: str = "1 hour"
) -> DataFrame:
    """Mean per source and time window."""
    return (
        df.withWatermark(ts, late)
        .groupBy(F.window(ts, length), source)
        .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), source, "mean", "n")
    )


def stream_flag_rate(
    df: DataFrame, *, ts: str, logits: str, threshold: float, length: str, slide: str, late: str = "1 hour"
) -> DataFrame:
    """Share of flagged rows per sliding window; the decision itself keeps no state."""
    decided = decide_labels(df.withWatermark(ts, late), logits, threshold=threshold)
    return (
        decided.groupBy(F.window(ts, length, slide))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("n_flagged"))
        .select(
            F.col("window.start").alias("window_start"), "n", "n_flagged",
            (100 * F.col("n_flagged") / F.col("n")).alias("flag_pct"),
        )
    )


def stream_best_of_n(df: DataFrame, *, key: str, output: str, score: str, pos: str) -> DataFrame:
    """Best answer so far per input, by the rule of the batch form.

    An input may get answers at any time, so its state (two answers) is kept for as long as the
    query runs; end the query, or start one per set of inputs, to release it.
    """
    return best_of_n(df, key, score, pos, output)


def start_snapshot_sink(
    df: DataFrame, path: str, checkpoint: str, *, every: int, step: str = "step", once: bool = True
) -> StreamingQuery:
    """Write the rows of every ``every``-th step, one folder per micro-batch and step.

    A repeated micro-batch overwrites its own folder, so a restart leaves no doubles.
    """

    def save(batch: DataFrame, number: int) -> None:
        due = batch.filter(F.col(step) % every == 0)
        due.write.mode("overwrite").partitionBy(step).parquet(f"{path}/batch={number}")

    writer = df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_histograms(
    df: DataFrame, path: str, checkpoint: str, *, query: str, value: str, by: list[str], k: int = SKETCH, once: bool = True
) -> StreamingQuery:
    """Log how the values of each group are distributed while they come in: one sketch per group and micro-batch, added once.

    Read them with ``read_histograms``, over any bins and at any time.
    """
    def save(batch: DataFrame, number: int) -> None:
        add_batch(value_sketches(batch, value, by=by, k=k), path, query=query, batch=number)

    writer = df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_histograms(spark: SparkSession, path: str, bins: int, *, by: list[str]) -> DataFrame:
    """Counts per group in equally wide bins over the range of all values so far, out of the merged sketches."""
    merged = read_batches(spark, path).groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return sketch_histogram(cut_lineage(merged), bins, by=by)


@contextmanager
def state_partitions(spark: SparkSession, partitions: int | None):
    """Number of state partitions for queries started inside.

    A streaming query keeps the number it was first started with, and every micro-batch
    pays for each of them, so it should follow the cores, not the batch default.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    if partitions is not None:
        spark.conf.set(name, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_end(
    df: DataFrame, path: str, checkpoint: str, *, mode: str = "append", partitions: int | None = None
) -> None:
    """Run a stream over all available input and leave the results as parquet.

    In ``complete`` and ``update`` mode each micro-batch writes its own folder; see
    ``newest_rows``.
    """
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", path)
    else:
        def save(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part-{number}")

        writer = df.writeStream.foreachBatch(save)
    writer = writer.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with state_partitions(df.sparkSession, partitions):
        query = writer.start()
    query.awaitTermination()


def newest_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Last state of each key out of the micro-batches of an update-mode stream."""
    rest = [c for c in df.columns if c not in keys and c != "_batch"]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
    return newest.select(*keys, "_r.*")
