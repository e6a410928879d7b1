"""Queries: filters, limits, task builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import filters as fl
from tunedata.operators import tasks as tk
from tunedata.plans.registry import EXAMPLES_SQL, examples, query, table

WORDS_SQL = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


def _trainable(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.col("text").alias("prompt"),
        F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 13 == 0, F.lit(None)).otherwise(F.col("source")).alias("response"),
        fl.word_count(F.col("text"), 512).alias("prompt_tokens"),
    )


@query("flt_length", f"""
SELECT doc_id, least({WORDS_SQL}, 512) AS prompt_tokens FROM documents
WHERE least({WORDS_SQL}, 512) < 510 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0
""")
def flt_length(spark, sf_dir):
    return fl.keep_trainable(_trainable(spark, sf_dir), max_length=512).select("doc_id", "prompt_tokens")


@query("flt_bypass", "SELECT doc_id, 0 AS prompt_tokens FROM documents")
def flt_bypass(spark, sf_dir):
    return fl.keep_trainable(_trainable(spark, sf_dir), max_length=512, pretrain=True).select("doc_id", "prompt_tokens")


@query("flt_unsafe", """
SELECT d.doc_id, d.text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.toxic = 0, FALSE)
""")
def flt_unsafe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return fl.keep_unsafe(docs.withColumn("is_safe", F.col("toxic") == 0)).select("doc_id", "text")


@query("flt_eq", "SELECT doc_id, text FROM documents WHERE source = 'src4'")
def flt_eq(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("source") == "src4").select("doc_id", "text")


@query("lim_first_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def lim_first_n(spark, sf_dir):
    return fl.first_rows(table(spark, sf_dir, "documents"), 100, "doc_id").select("doc_id", "lang")


@query("lim_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 701")
def lim_offset(spark, sf_dir):
    return fl.first_rows(table(spark, sf_dir, "orders"), 100, "o_orderkey", offset=701).select("o_orderkey", "o_totalprice")


@query("flt_source", f"""
WITH e AS ({EXAMPLES_SQL})
SELECT 'all' AS flag, doc_id FROM e UNION ALL SELECT 'ft', doc_id FROM e WHERE toxic = 0
UNION ALL SELECT 'harmful', doc_id FROM e WHERE toxic = 1
""")
def flt_source(spark, sf_dir):
    rows = examples(spark, sf_dir).select("doc_id", "source")
    parts = [fl.keep_source(rows, f).select(F.lit(f).alias("flag"), "doc_id") for f in fl.SOURCE_FLAGS]
    return parts[0].union(parts[1]).union(parts[2])


@query("flt_any_map", "SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0")
def flt_any_map(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    marks = F.create_map(F.lit("toxic"), F.col("toxic") == 1, F.lit("low_quality"), F.col("quality") == 0)
    return labels.filter(fl.any_true(marks)).select("doc_id")


@query("flt_isin", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'system')")
def flt_isin(spark, sf_dir):
    return fl.keep_values(table(spark, sf_dir, "conversations"), "role", ["user", "system"]).select("conv_id", "turn")


@query("flt_cadence", """
SELECT 'every50' AS rule, event_id FROM events WHERE event_id % 50 = 0
UNION ALL SELECT 'epoch', event_id FROM events WHERE event_id % 300 = 0
""")
def flt_cadence(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    rules = [("every50", 50), ("epoch", -1), ("never", -2)]
    parts = [
        fl.keep_cadence(events, every, 300, step="event_id").select(F.lit(name).alias("rule"), "event_id")
        for name, every in rules
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("task_binary", """
SELECT d.doc_id, 'Analyze the sentiment of the input, and respond only positive or negative' AS instruction,
       d.text AS input, CASE WHEN l.quality = 0 THEN 'negative' ELSE 'positive' END AS output
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def task_binary(spark, sf_dir):
    rows = examples(spark, sf_dir).select("doc_id", F.col("text").alias("sentence"), F.col("quality").alias("label"))
    return tk.sentiment_task(rows)


@query("task_multiclass", f"""
SELECT d.doc_id, '{tk.NEWS_INSTRUCTION}' AS instruction, d.text AS input,
       ['World', 'Sports', 'Business', 'Sci/Tech'][l.quality + 2 * l.toxic + 1] AS output
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def task_multiclass(spark, sf_dir):
    rows = examples(spark, sf_dir).select("doc_id", "text", (F.col("quality") + 2 * F.col("toxic")).alias("label"))
    return tk.news_task(rows)


@query("task_marker", """
SELECT doc_id, text AS instruction, lang || ' The final answer is:  ' || n_chars AS output FROM documents
""")
def task_marker(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("question"),
        F.concat(F.col("lang"), F.lit(" #### "), F.col("n_chars").cast("string")).alias("answer"))
    return tk.arithmetic_task(docs)


@query("task_head", """
SELECT doc_id, text AS instruction, lang AS output FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 700
""")
def task_head(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("instruction"), F.col("lang").alias("output"), F.col("source").alias("generator"))
    return tk.generator_task(docs, "src1", 700, "doc_id")
