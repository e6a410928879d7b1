"""Tables that a batch is added to once, however often it is written.

A batch is known by the query it belongs to and its number. Its rows go to a folder of their own attempt;
then one row in the ledger names the attempt. Readers see the attempts that the ledger names, one for each
batch, so rows of a write that failed, or was repeated after a restart, are never counted.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

_LEDGER = "query string, batch bigint, attempt string"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """One attempt for each committed batch; empty before the first."""
    try:
        entries = spark.read.schema(_LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        entries = spark.createDataFrame([], _LEDGER)
    return entries.groupBy("query", "batch").agg(F.min("attempt").alias("attempt"))


def stage(df: DataFrame, path: str, *, query: str, batch: int) -> str:
    """Write the rows of a batch where no reader looks yet; returns the attempt's name."""
    attempt = f"a{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(f"{path}/rows/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, path: str, attempt: str, *, query: str, batch: int) -> None:
    """Name the attempt in the ledger: one file, which is there or not."""
    entry = spark.createDataFrame([(query, batch, attempt)], _LEDGER)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def add_batch(df: DataFrame, path: str, *, query: str, batch: int) -> bool:
    """Add the rows of a batch unless it was added before; whether it was added now.

    Two writers of the same batch at once may both write, but readers see one of them.
    """
    spark = df.sparkSession
    done = _ledger(spark, path).filter((F.col("query") == query) & (F.col("batch") == batch))
    if not done.isEmpty():
        return False
    commit(spark, path, stage(df, path, query=query, batch=batch), query=query, batch=batch)
    return True


def read_batches(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of all committed batches, with ``query`` and ``batch``. Without a schema there must be some rows."""
    ledger = _ledger(spark, path)
    if schema is None:
        return spark.read.parquet(f"{path}/rows").join(ledger, "attempt").drop("attempt")
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if ledger.isEmpty():
        return spark.createDataFrame([], T.StructType([*kind, T.StructField("query", T.StringType()), T.StructField("batch", T.LongType())]))
    rows = spark.read.schema(T.StructType([*kind, T.StructField("attempt", T.StringType())])).parquet(f"{path}/rows")
    return rows.join(ledger, "attempt").drop("attempt")


def start_batches(df: DataFrame, path: str, checkpoint: str, *, query: str, once: bool = True) -> StreamingQuery:
    """Add every micro-batch of a stream under its number."""
    def save(batch: DataFrame, number: int) -> None:
        add_batch(batch, path, query=query, batch=number)

    writer = df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
