"""Sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tunedata.sources.ledger import add_batch, read_batches, start_batches


def write_json(df: DataFrame, path: str, mode: str = "error") -> str:
    """JSON Lines, one record per line."""
    df.write.mode(mode).json(path)
    return path


def write_json_array(df: DataFrame, path: str) -> str:
    """JSON lists of records, one list per file and one file per partition.

    Rows pass through one at a time, so a list may be longer than memory.
    """

    def bracket(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["["]})
        first = True
        for frame in frames:
            lines = frame["value"].tolist()
            if lines:
                yield pd.DataFrame({"value": [(line if first and i == 0 else "," + line) for i, line in enumerate(lines)]})
                first = False
        yield pd.DataFrame({"value": ["]"]})

    lines = df.select(F.to_json(F.struct("*")).alias("value"))
    lines.mapInPandas(bracket, "value string").write.text(path)
    return path


def write_manifest(examples: DataFrame, path: str) -> str:
    """Index, prompt, response and source of every example."""
    examples.select(F.col("id").alias("index"), "prompt", "response", "source").write.parquet(path)
    return path


def write_splits(scored: DataFrame, path: str, split: str = "source") -> str:
    """Ranked examples, one folder per split."""
    scored.write.partitionBy(split).parquet(path)
    return path


def write_snapshot(weights: DataFrame, path: str, *, run: str, step: int | None = None) -> str:
    """Logits and weights of one step (or of all steps of a table with a ``step`` column) of a run.

    A step is written whole: one that is there already is replaced, so a repeated write leaves it once.
    """
    out = weights.withColumn("run", F.lit(run))
    if step is not None:
        out = out.withColumn("step", F.lit(step))
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run", "step").parquet(path)
    return path


def write_subject_csv(df: DataFrame, path: str, subject: str = "subject") -> str:
    """One CSV folder per subject, all of its rows with model output and correctness."""
    df.write.option("header", True).option("escape", '"').partitionBy(subject).csv(path)
    return path


def summary_json(scores: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of JSON: scores of all subjects, groups and the total.

    Both inputs have one row per subject or group, which a single document must hold.
    """

    def as_map(df: DataFrame, key: str, score: str):
        entry = F.struct(F.col(key), F.struct(F.col(score).alias("score"), F.col("n"), F.col("n_correct").alias("correct")))
        return df.agg(F.map_from_entries(F.array_sort(F.collect_list(entry)))).scalar()

    spark = scores.sparkSession
    body = F.struct(
        as_map(scores, "subject", "score_pct").alias("subjects"), as_map(grouped, "grp", "score_frac").alias("grouped")
    )
    return spark.range(1).select(F.to_json(body).alias("summary"))


METRICS = "run string, step bigint, metric string, value double"


def append_metrics(df: DataFrame, path: str, *, query: str | None = None, batch: int = 0) -> str:
    """Append rows ``(run, step, metric, value)`` to the metrics table.

    With ``query`` the rows are batch number ``batch`` of that query, which is added once however often it is
    written; ``read_metrics`` gives the rows of such a table.
    """
    rows = df.select("run", "step", "metric", "value")
    if query is None:
        rows.write.mode("append").parquet(path)
    else:
        add_batch(rows, path, query=query, batch=batch)
    return path


def start_metrics(df: DataFrame, path: str, checkpoint: str, *, query: str, once: bool = True) -> StreamingQuery:
    """Append the metrics of a stream, every micro-batch once; rows as in ``append_metrics``."""
    return start_batches(df.select("run", "step", "metric", "value"), path, checkpoint, query=query, once=once)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the batches that were added under a query's name."""
    return read_batches(spark, path, METRICS).select("run", "step", "metric", "value")


def rewrite_renamed(df: DataFrame, path: str, renames: dict[str, str]) -> str:
    """Write JSON Lines with renamed fields."""
    df.withColumnsRenamed(renames).write.json(path)
    return path
