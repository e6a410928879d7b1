"""Named queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, sql.strip() if sql else None)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a stream of files; the table may be one file or a folder of them.

    A stream's path must be a folder unless it is a pattern, so the name is given as one that only it matches.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("basePath", sf_dir).parquet(f"{sf_dir}/{name}.parque[t]")


def r6(value, name: str) -> Column:
    """Rounded to the six decimals the comparison uses."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), 6).alias(name)


def pick(number: Column, options: list) -> Column:
    """The option with the given number (from 0); only that one is worked out."""
    result = F.when(number == 0, options[0])
    for i, option in enumerate(options[1:], start=1):
        result = result.when(number == i, option)
    return result


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as training examples with their source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").withColumn(
        "source", F.when(F.col("toxic") == 1, "harmful").otherwise("ft")
    )


EXAMPLES_SQL = """
SELECT d.doc_id, d.text, d.lang, d.n_chars, l.quality, l.toxic,
       CASE WHEN l.toxic = 1 THEN 'harmful' ELSE 'ft' END AS source
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


def weight_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logged logit per example."""
    return examples(spark, sf_dir).select(
        F.col("doc_id").alias("example_id"),
        ((F.col("n_chars") % 97) / 97.0 + F.col("quality") * 0.5 - F.col("toxic")).cast("double").alias("logit"),
    )


WEIGHT_STATE_SQL = f"""
SELECT doc_id AS example_id, (n_chars % 97) / 97.0::DOUBLE + quality * 0.5::DOUBLE - toxic AS logit
FROM ({EXAMPLES_SQL})
"""
