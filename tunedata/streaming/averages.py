"""Moving averages of streams, in step order whatever order and files the rows arrive in.

Every micro-batch is a batch job over the rows held back so far and the new ones. Rows wait until the
step of their run is ``delay`` below the highest one seen; what is due then is averaged by the batch
operator, which cuts a long run into blocks and merges their ends, and goes on from one number per run. So
a run may lie over many tasks, and rows that are no later than ``delay`` steps give the average of
the whole table, however they were cut into files and micro-batches.

A micro-batch reads the state its predecessor wrote and overwrites folders of its own number, so one that
is run again after a failure leaves the same rows once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tunedata.operators.monitoring import LOSS_DECAY, ema
from tunedata.sources.listing import folder_numbers

_CARRIED = "last bigint, mean double, top bigint"
_ARRIVED = "step bigint, value double, late boolean"


def _carried(spark: SparkSession, path: str, number: int | None, run_type: str) -> DataFrame:
    """(run, last, mean, top): the step up to which a run is done, its average there, and its highest step."""
    if number is None:
        return spark.createDataFrame([], f"run {run_type}, {_CARRIED}")
    return spark.read.schema(f"run {run_type}, {_CARRIED}").parquet(f"{path}/state/batch={number}")


def _arrived(spark: SparkSession, path: str, number: int, run_type: str) -> DataFrame:
    """What a micro-batch had before it: its new rows, those too late among them, and those held back till then."""
    return spark.read.schema(f"run {run_type}, {_ARRIVED}").parquet(f"{path}/arrived/batch={number}")


def _placed(spark: SparkSession, path: str, number: int, run_type: str, state: DataFrame) -> DataFrame:
    """The rows of a micro-batch that are not late, with the state of their run."""
    return _with_carried(_arrived(spark, path, number, run_type).filter("not late").drop("late"), state)


def _with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows with last, mean and top of their run; null for a new one."""
    state = carried.withColumnRenamed("run", "_run")
    return rows.join(state, F.col("run").eqNullSafe(F.col("_run")), "left").drop("_run")


def _averaged(due: DataFrame, decay: float) -> DataFrame:
    """(run, step, value, ema) of rows with the ``mean`` they go on from."""
    started = due.withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    return ema(started, "value", step="step", by=["run"], tie=["value"], decay=decay, start="mean").select("run", "step", "value", "ema")


def start_ema(
    df: DataFrame, path: str, checkpoint: str, *, run: str, step: str, value: str, decay: float = LOSS_DECAY, delay: int = 0, once: bool = True,
) -> StreamingQuery:
    """Start the moving average of every run of a stream; read it with ``read_ema`` and ``read_late``.

    A row whose step is not above the step up to which its run is done changes nothing and goes to the late
    rows. Rows that repeat a step before it is done all count, in the order of their values. Null
    steps and values are late at once; a null run is a run.
    """
    rows = df.select(F.col(run).alias("run"), F.col(step).cast("bigint").alias("step"), F.col(value).cast("double").alias("value"))
    kind = rows.schema["run"].dataType.simpleString()

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = number - 1 if number else None
        carried = _carried(spark, path, before, kind)
        known = _with_carried(batch, carried.select("run", "last"))
        late = F.coalesce(F.col("step") <= F.col("last"), F.lit(False)) | F.col("step").isNull() | F.col("value").isNull()
        new = known.select("run", "step", "value", late.alias("late"))
        if before is not None:
            waiting = _placed(spark, path, before, kind, carried).filter(F.col("step") > F.col("last"))
            new = new.unionByName(waiting.select("run", "step", "value", F.lit(False).alias("late")))
        new.write.mode("overwrite").parquet(f"{path}/arrived/batch={number}")

        rows = _arrived(spark, path, number, kind).filter("not late")
        tops = rows.groupBy("run").agg(F.max("step").alias("new")).withColumnRenamed("run", "_new")
        state = carried.join(tops, F.col("run").eqNullSafe(F.col("_new")), "full").select(
            F.when(F.col("new").isNull(), F.col("run")).otherwise(F.col("_new")).alias("run"), "mean",
            F.greatest("top", "new").alias("top"), F.greatest("last", F.greatest("top", "new") - delay).alias("last"))
        due = _placed(spark, path, number, kind, state).filter(F.col("step") <= F.col("last"))
        _averaged(due, decay).write.mode("overwrite").parquet(f"{path}/ema/batch={number}")

        done = spark.read.schema(f"run {kind}, step bigint, value double, ema double").parquet(f"{path}/ema/batch={number}")
        ends = done.groupBy("run").agg(F.max_by("ema", F.struct("step", "value")).alias("_mean")).withColumnRenamed("run", "_run")
        after = state.join(ends, F.col("run").eqNullSafe(F.col("_run")), "left")
        after.select("run", "last", F.coalesce("_mean", "mean").alias("mean"), "top").write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_ema(spark: SparkSession, path: str, *, decay: float = LOSS_DECAY, flush: bool = True) -> DataFrame:
    """(run, step, value, ema) of all rows that are done; with ``flush`` also of those still held back, as if the input ended here."""
    done = spark.read.parquet(f"{path}/ema").drop("batch")
    if not flush:
        return done
    number = max(folder_numbers(spark, f"{path}/state", "batch"))
    kind = done.schema["run"].dataType.simpleString()
    waiting = _placed(spark, path, number, kind, _carried(spark, path, number, kind)).filter(F.col("step") > F.col("last"))
    return done if waiting.isEmpty() else done.unionByName(_averaged(waiting, decay))


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """(run, step, value) of the rows that came too late to count."""
    return spark.read.parquet(f"{path}/arrived").filter("late").select("run", "step", "value")
