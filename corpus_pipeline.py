"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of their input, whatever other
columns it has. Null ids, null and empty texts and repeated rows pass through every stage with a
defined result; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tunedata.llm import decontam, langid, lines, mixing, neardup
from tunedata.llm.text import row_key, table
from tunedata.session import cut_lineage


def _packed(docs: DataFrame) -> DataFrame:
    """Id and text beside the whole row, so that no other column can clash with a stage's own."""
    return docs.select("doc_id", "text", F.struct("*").alias("row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones teach: not those without text or letters, nor noise."""
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.with_language(_packed(docs), model).filter(langid.is_language()).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from the texts, and documents of which nothing else is left; n_chars follows the text."""
    cleaned = lines.dedup_lines(_packed(docs))
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    row = F.when(F.col("n_removed") > 0, changed).otherwise(F.col("row"))
    return cleaned.filter(left).select(row.alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the least id, of rows that share it the least text key.

    Documents without words are in no group and stay. Of repeated rows one stays.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text")).filter("kept")
    grouped = found.filter("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("key.id").isNull(), "key"))["key"].alias("key"))
    keyed = _packed(docs).withColumn("key", row_key("doc_id", "text"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    one = keyed.filter(worded).join(grouped.select("key"), "key", "left_semi").dropDuplicates(["key"])
    return one.select("row.*").unionByName(keyed.filter(~worded).select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    found = decontam.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    keyed = _packed(docs).withColumn("key", row_key("doc_id", "text"))
    return keyed.join(found.select("key"), "key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the training mix takes of each document."""
    return mixing.taken_words(*mixing.mix(docs.select("doc_id", "text", "source")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Language scores and sketches have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
