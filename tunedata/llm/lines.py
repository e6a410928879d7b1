"""Remove repeated passages, found as overlapping windows of three lines.

A window is three consecutive lines that hold a word; lines without words stand between them
unseen. All windows of all documents are hashed, the first occurrence of each is found globally,
and every later one is removed: the lines that removed windows cover are merged and left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunedata.llm.text import free_name, row_key
from tunedata.session import cut_lineage

WIDTH = 3
_WORDED = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, pos, first, last, hash, check): every window of every document, ``pos`` counting lines with words,
    ``first`` and ``last`` all lines.

    A document with fewer such lines, but not none, is one window.
    """
    numbered = F.transform(_lines(F.col(text_col)), lambda line, i: F.struct(i.alias("n"), line.alias("line")))
    lined = docs.filter(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("key"), F.filter(numbered, lambda x: x["line"].rlike(_WORDED)).alias("lines"))
    size = F.size("lines")

    def window(i: Column) -> Column:
        held = F.slice(F.col("lines"), i + 1, width)
        last = F.element_at("lines", F.least(i + width, size))["n"]
        return F.struct(i.alias("pos"), F.element_at("lines", i + 1)["n"].alias("first"), last.alias("last"), F.array_join(held["line"], "\n").alias("window"))

    at = F.sequence(F.lit(0), F.greatest(size - width, F.lit(0)))
    return lined.filter(size > 0).select("key", F.explode(F.transform(at, window)).alias("w")).select(
        "key", "w.pos", "w.first", "w.last", F.xxhash64("w.window").alias("hash"), F.xxhash64(F.lit("2"), "w.window").alias("check"))


def later_windows(found: DataFrame) -> DataFrame:
    """(key, removed): first and last lines of the windows that occurred before, for each document that has any.

    The order is by id (null last), then text, then position.
    """
    place = F.struct(F.col("key.id").isNull().alias("last"), "key", "pos")
    first = found.groupBy("hash", "check").agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(first, ["hash", "check"]).filter((F.col("origin.key") != F.col("key")) | (F.col("origin.pos") != F.col("pos")))
    return later.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents with later occurrences of windows removed, and n_lines, n_removed.

    Of a window that recurs within a document too, the first occurrence counts, so where occurrences
    overlap the first lines stay. Rows that repeat id and text are one document and come out alike.
    Null texts stay null, with 0 lines; a text of which nothing is left becomes empty. A null id
    comes last in order. An empty table gives an empty result. Columns of the table that are named
    n_lines or n_removed are replaced; all others are kept.
    """
    kept = docs.drop("n_lines", "n_removed")
    key, gone, lines, covered = (free_name(kept, name) for name in ("row_key", "removed_windows", "all_lines", "covered_lines"))
    found = cut_lineage(windows(kept, id_col, text_col, width))
    removed = later_windows(found).withColumnRenamed("key", key).withColumnRenamed("removed", gone)
    joined = kept.withColumn(key, row_key(id_col, text_col)).join(removed, key, "left")
    # The lines are a column of their own, as inside a lambda they would be split again for every element.
    split = joined.withColumn(lines, F.when(F.col(gone).isNotNull(), _lines(F.col(text_col))))
    inside = F.flatten(F.transform(gone, lambda w: F.sequence(w["first"], w["last"])))
    wordless = F.filter(F.transform(lines, lambda line, i: F.when(~line.rlike(_WORDED), i)), lambda i: i.isNotNull())
    merged = split.withColumn(covered, F.array_except(inside, wordless))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covered))
    text = F.array_join(F.transform(stay, lambda i: F.element_at(F.col(lines), i + 1)), "\n")
    return (
        merged.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_lines(F.col(text_col)))).cast("long"))
        .withColumn("n_removed", F.when(F.col(gone).isNull(), 0).otherwise(F.size(covered)).cast("long"))
        .withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(text))
        .drop(key, gone, lines, covered)
    )


def dedup_lines_sql(documents: str) -> str:
    """The same in DuckDB's SQL, with the windows themselves in place of hashes."""
    return rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM {documents}),
k AS (SELECT DISTINCT doc_id, text, lines, list_filter(range(len(lines)), lambda i: regexp_matches(lines[i + 1], '[^\x20\x09-\x0D]')) AS worded
      FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, p, array_to_string([lines[i + 1] FOR i IN worded[p + 1:p + 3]], chr(10)) AS win
      FROM (SELECT *, unnest(range(greatest(len(worded) - 2, 1))) AS p FROM k WHERE len(worded) > 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, text, p) AS n FROM w),
g AS (SELECT doc_id, text, list(p) AS removed FROM r WHERE n > 1 GROUP BY doc_id, text),
c AS (SELECT k.doc_id, k.text, k.lines, list_distinct(flatten([worded[p + 1:p + 3] FOR p IN removed])) AS covered
      FROM k JOIN g ON k.doc_id IS NOT DISTINCT FROM g.doc_id AND k.text = g.text)
SELECT d.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(covered), 0) AS BIGINT) AS n_removed,
       CASE WHEN covered IS NULL THEN d.text
            ELSE array_to_string([d.lines[i + 1] FOR i IN range(len(d.lines)) IF NOT list_contains(covered, i)], chr(10)) END AS text
FROM d LEFT JOIN c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text = c.text"""
