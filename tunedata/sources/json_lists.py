"""Reading JSON lists of records in parallel, however large one list is.

Files are read as texts that end at each closing brace, which Spark splits by bytes like lines. Whether a text begins
inside a string, and how deep, follows from all texts before it in the file: quotes are counted along
the file first, and with that the brackets outside of strings. A record ends at the brace that leaves
only the list itself open; the texts up to there are put together and parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tunedata.operators.indexing import running_sums
from tunedata.session import cut_lineage


def _outside(segments: Column, parity: int) -> Column:
    """Brackets opened less those closed, in every second segment between quotes."""
    plain = F.array_join(F.filter(segments, lambda _, i: i % 2 == parity), "")

    def count(signs: str) -> Column:
        return F.length(plain) - F.length(F.translate(plain, signs, ""))

    return (count("{[") - count("}]")).cast("bigint")


def read_json_list(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of all files below a path that each hold one JSON list of objects.

    A list of any length is many tasks, of ``spark.sql.files.maxPartitionBytes`` each. Quotes, brackets and line
    breaks within strings do not matter, nor do nested objects and lists. Rows have no order. A record that cannot
    be parsed is a row of nulls; an empty list, or an empty file, has no rows. Compressed files are one task each.
    """
    texts = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value"
    ).withColumn("row", F.monotonically_increasing_id())
    pieces = cut_lineage(texts)
    # An escaped sign is neither a quote nor a bracket; escapes occur in strings only and end before a brace.
    segments = F.split(F.regexp_replace("value", r"\\.", ""), '"')
    seen = pieces.select("file", "begin", "row", (F.size(segments) - 1).cast("bigint").alias("quotes"), _outside(segments, 0).alias("even"), _outside(segments, 1).alias("odd"))
    order = {"by": ["file"], "tie": ["row"]}
    seen = running_sums(cut_lineage(seen), "begin", {"upto": F.col("quotes")}, **order)
    inside = (F.col("upto") - F.col("quotes")) % 2 == 1
    closes = F.col("upto") % 2 == 0  # the brace at the end is no sign of a string
    change = F.when(inside, F.col("odd")).otherwise(F.col("even")) - closes.cast("bigint")
    seen = seen.select("file", "begin", "row", closes.alias("closes"), change.alias("change"))
    deep = running_sums(cut_lineage(seen), "begin", {"depth": F.col("change")}, **order)
    ends = (F.col("closes") & (F.col("depth") == 1)).cast("bigint")
    numbered = running_sums(cut_lineage(deep.select("file", "begin", "row", ends.alias("ends"))), "begin", {"upto": F.col("ends")}, **order)
    records = numbered.select("row", (F.col("upto") - F.col("ends")).alias("record"), "ends")
    # A record is in one row of the result, so its texts may meet in one task.
    whole = pieces.join(records, "row").groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("begin", "row", "value"))).alias("parts"), F.max("ends").alias("ended"))
    joined = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    record = F.regexp_replace(joined, r"^[\s,\x{FEFF}]*\[?[\s,]*", "")
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return whole.filter("ended = 1").select(F.from_json(record, kind).alias("r")).select("r.*")
