"""Readers for corpora, exams, mappings and weight snapshots."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tunedata.sources.listing import folder_numbers

# --- fixed values: file endings, exam file names, snapshots read for curves ----------
FORMATS = {".json": "json", ".jsonl": "json", ".csv": "csv", ".parquet": "parquet", ".txt": "text"}
EXAM_FILE = r"([^/]+?)(?:_(?:val|dev|test))?\.csv$"
CURVE_MULTIPLES = range(6, 21)
# ------------------------------------------------------------------------------------


def folder_ending(spark: SparkSession, path: str) -> str:
    """The first of the known endings that any file below a folder has."""
    for ending in FORMATS:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(path)
        if not listed.select("path").limit(1).isEmpty():
            return ending
    raise ValueError(f"no file below {path} ends in one of {list(FORMATS)}")


def read_corpus(spark: SparkSession, path: str, schema: str | None = None, *, multi_line: bool = False) -> DataFrame:
    """Read a file or folder by the ending of its name, or a plain folder by that of the files in it.

    CSV values may hold line breaks only with ``multi_line``, which makes each file one task.
    """
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending in FORMATS:
        return _reader(spark, FORMATS[ending], schema, multi_line).load(path)
    if ending:
        raise ValueError(f"unknown file ending {ending!r}, expected one of {sorted(FORMATS)}")
    ending = folder_ending(spark, path)
    if ending == ".parquet":  # keeps the columns of partition folders
        return _reader(spark, "parquet", schema, multi_line).load(path)
    return read_directory(spark, path, ending, schema, multi_line=multi_line)


def _reader(spark: SparkSession, fmt: str, schema: str | None, multi_line: bool):
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return reader.schema(schema) if schema and fmt != "text" else reader


def read_directory(
    spark: SparkSession, path: str, ending: str | None = None, schema: str | None = None, *, multi_line: bool = False
) -> DataFrame:
    """All files with one ending below a folder; without one, the first that occurs there."""
    ending = folder_ending(spark, path) if ending is None else ending
    if ending not in FORMATS:
        raise ValueError(f"unknown file ending {ending!r}")
    reader = _reader(spark, FORMATS[ending], schema, multi_line)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(path)


def read_named(spark: SparkSession, root: str, name: str, schema: str | None = None, *, multi_line: bool = False) -> DataFrame:
    """A corpus of any format below ``root`` as ``name`` or ``name@subfolder``."""
    parts = name.split("@")
    if len(parts) > 2:
        raise ValueError(f"at most one @ in a corpus name, got {name!r}")
    return read_corpus(spark, "/".join([root, *(p.strip() for p in parts)]), schema, multi_line=multi_line)


def read_splits(
    spark: SparkSession, root: str, name: str, splits: tuple[str, ...] = (), schema: str | None = None, *, multi_line: bool = False
) -> dict[str, DataFrame]:
    """The given subfolders of a corpus as its splits, or the whole corpus as ``all``."""
    if not splits:
        return {"all": read_named(spark, root, name, schema, multi_line=multi_line)}
    base = "/".join([root, *(p.strip() for p in name.split("@"))])
    return {s: read_corpus(spark, f"{base}/{s}", schema, multi_line=multi_line) for s in splits}


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON list of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_exams(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Exam CSV files, with the subject taken from the file name."""
    table = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option(
        "recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    return table.withColumn("subject", F.regexp_extract(F.col("_metadata.file_path"), EXAM_FILE, 1))


def read_subject_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``subject -> [english, chinese, group]`` as a table."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("subject", "_v")).select(
        "subject",
        F.get("_v", F.lit(0)).alias("name_en"),
        F.get("_v", F.lit(1)).alias("name_zh"),
        F.get("_v", F.lit(2)).alias("grp"),
    )


def read_snapshots(spark: SparkSession, path: str, steps: list[int] | None = None) -> DataFrame:
    """Weight snapshots, only the folders of the wanted steps."""
    table = spark.read.parquet(path)
    return table if steps is None else table.filter(F.col("step").isin(steps))


def curve_steps(step: int) -> list[int]:
    """Steps whose snapshots make up a density plot."""
    return [i * step for i in CURVE_MULTIPLES]


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Rows of the largest step; an empty table is an error."""
    last = snapshots.agg(F.max("step")).scalar()
    found = F.assert_true(last.isNotNull(), F.lit("no snapshot found"))
    return snapshots.filter((F.col("step") == last) & found.isNull())


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the largest step below a folder of snapshots; the step is read off the folder names."""
    steps = folder_numbers(spark, path, "step")
    if not steps:
        raise ValueError(f"no snapshot found below {path}")
    return read_snapshots(spark, path, steps[-1:])
