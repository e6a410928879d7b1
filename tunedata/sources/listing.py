"""What folder names tell, without opening a file."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F


def folder_numbers(spark: SparkSession, path: str, column: str) -> list[int]:
    """The numbers that ``column=<number>`` folders below a path have, rising.

    Files are listed, not opened. One number per folder comes back.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    number = F.regexp_extract("path", rf"[/]{column}=(-?\d+)(?:/|$)", 1)
    found = files.select(number.alias("n")).filter("n <> ''").distinct().select(F.col("n").cast("bigint").alias("n"))
    return sorted(r["n"] for r in found.collect())
