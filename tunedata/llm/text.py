"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Runs of anything but ASCII white space (Java and Python alike).
WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id_col: str, text_col: str) -> Column:
    """What identifies a row: its id with 128 bits of its text.

    Rows that repeat both are one document to the operators and get the same result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.struct(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("2"), text).alias("h2"),
        F.col(text_col).isNull().alias("none"),
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front while the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
