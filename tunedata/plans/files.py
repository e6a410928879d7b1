"""Queries: sources and sinks. Each writes below the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import exams as ex
from tunedata.plans.ranks import SNAPSHOTS_SQL, snapshots
from tunedata.plans.registry import EXAMPLES_SQL, examples, query, r6, stream, table
from tunedata.plans.scoring import EXAM_SQL, _exam
from tunedata.operators.indexing import dense_ids
from tunedata.functions.arrays import sigmoid
from tunedata.session import scratch_path
from tunedata.sources import readers as rd
from tunedata.sources.json_lists import read_json_list
from tunedata.sources import writers as wr

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("src_formats", """
WITH d AS (SELECT doc_id, text, lang FROM documents)
SELECT 'json' AS format, * FROM d UNION ALL SELECT 'jsonl', * FROM d UNION ALL SELECT 'csv', * FROM d
UNION ALL SELECT 'parquet', * FROM d UNION ALL SELECT 'txt', NULL, source || ' ' || lang, NULL FROM documents
""")
def src_formats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    base, parts = scratch_path(spark, "formats"), []
    for name in ("json", "jsonl", "csv", "parquet"):
        writer = docs.write.option("header", True).option("escape", '"')
        writer.format({"jsonl": "json"}.get(name, name)).save(f"{base}/all.{name}")
        back = rd.read_corpus(spark, f"{base}/all.{name}", DOC_SCHEMA, multi_line=name == "csv")
        parts.append(back.select(F.lit(name).alias("format"), "doc_id", "text", "lang"))
    docs.select(F.concat_ws(" ", "source", "lang").alias("value")).write.text(f"{base}/all.txt")
    lines = rd.read_corpus(spark, f"{base}/all.txt")
    null = F.lit(None)
    out = lines.select(F.lit("txt").alias("format"), null.cast("bigint").alias("doc_id"), F.col("value").alias("text"), null.cast("string").alias("lang"))
    for part in parts:
        out = out.unionByName(part)
    return out


@query("src_directory", "SELECT doc_id, lang, text FROM documents")
def src_directory(spark, sf_dir):
    base = scratch_path(spark, "tree")
    docs = table(spark, sf_dir, "documents")
    docs.write.partitionBy("lang").json(f"{base}/nested")
    docs.select("text").write.text(f"{base}/other")
    back = rd.read_directory(spark, base, None, "doc_id bigint, text string")
    lang = F.regexp_extract(F.col("_metadata.file_path"), "lang=([^/]+)/", 1)
    return back.select("doc_id", lang.alias("lang"), "text")


@query("src_named", """
SELECT 'whole' AS corpus, doc_id, text FROM documents UNION ALL SELECT 'part', doc_id, text FROM documents WHERE lang = 'fr'
""")
def src_named(spark, sf_dir):
    base = scratch_path(spark, "corpora")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs.drop("lang").write.parquet(f"{base}/docs")
    docs.filter(F.col("lang") == "fr").drop("lang").write.json(f"{base}/sub/fr")
    whole, part = rd.read_named(spark, base, "docs"), rd.read_named(spark, base, "sub@fr")
    columns = ("doc_id", "text")
    return whole.select(F.lit("whole").alias("corpus"), *columns).union(part.select(F.lit("part").alias("corpus"), *columns))


@query("src_json_array", "SELECT conv_id, turn, text FROM conversations")
def src_json_array(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").repartition("conv_id")
    path = wr.write_json_array(turns, scratch_path(spark, "arrays"))
    back = rd.read_json_array(spark, path, "conv_id bigint, turn bigint, text string")
    return back.select("conv_id", "turn", "text")


@query("src_json_list", "SELECT conv_id, turn, text FROM conversations")
def src_json_list(spark, sf_dir):
    """All conversations as one list in one file."""
    turns = table(spark, sf_dir, "conversations").coalesce(1)
    path = wr.write_json_array(turns, scratch_path(spark, "list"))
    return read_json_list(spark, path, "conv_id bigint, turn bigint, text string").select("conv_id", "turn", "text")


@query("src_exam_csv", "SELECT lang AS subject, text AS question, source AS \"A\", lang AS \"B\", CAST(n_chars AS VARCHAR) AS answer FROM documents")
def src_exam_csv(spark, sf_dir):
    """One folder per exam, named like the exam's file."""
    base = scratch_path(spark, "exams")
    docs = table(spark, sf_dir, "documents").select(
        "lang", F.col("text").alias("question"), F.col("source").alias("A"), F.col("lang").alias("B"),
        F.col("n_chars").cast("string").alias("answer"))
    docs.select("question", "A", "B", "answer", F.concat("lang", F.lit("_test.csv")).alias("exam")).write.option(
        "header", True).option("escape", '"').partitionBy("exam").csv(base)
    back = rd.read_exams(spark, base, "question string, A string, B string, answer string")
    subject = F.regexp_extract(F.col("_metadata.file_path"), "exam=([^/]+?)_test.csv/", 1)
    return back.withColumn("subject", subject).select("subject", "question", "A", "B", "answer")


@query("src_mapping", """
SELECT n_name AS subject, upper(n_name) AS name_en, lower(n_name) AS name_zh, r_name AS grp
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def src_mapping(spark, sf_dir):
    path = scratch_path(spark, "mapping")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct("n_name", F.array(F.upper("n_name"), F.lower("n_name"), F.col("r_name")))
    nation.agg(F.to_json(F.map_from_entries(F.collect_list(entry)))).write.text(path)
    return rd.read_subject_map(spark, path)


def _written_snapshots(spark, sf_dir) -> str:
    path = scratch_path(spark, "snapshots")
    rows = snapshots(spark, sf_dir).withColumn("weight", 2 * sigmoid(F.col("logit")))
    return wr.write_snapshot(rows.select("step", "example_id", "source", "logit", "weight"), path, run="base")


@query("snap_range", f"SELECT step, example_id, round(logit, 6) AS logit FROM ({SNAPSHOTS_SQL}) WHERE step >= 60")
def snap_range(spark, sf_dir):
    wanted = rd.curve_steps(10)
    back = rd.read_snapshots(spark, _written_snapshots(spark, sf_dir), wanted)
    return back.select("step", "example_id", r6("logit", "logit"))


@query("snap_latest", f"SELECT step, example_id, round(logit, 6) AS logit FROM ({SNAPSHOTS_SQL}) WHERE step = 200")
def snap_latest(spark, sf_dir):
    back = rd.read_latest(spark, _written_snapshots(spark, sf_dir))
    return back.select("step", "example_id", r6("logit", "logit"))


@query("snap_write", f"""
SELECT 'base' AS run, step, example_id, source, round(logit, 6) AS logit, round(2 / (1 + exp(-logit)), 6) AS weight FROM ({SNAPSHOTS_SQL})
""")
def snap_write(spark, sf_dir):
    back = rd.read_snapshots(spark, _written_snapshots(spark, sf_dir))
    return back.select("run", "step", "example_id", "source", r6("logit", "logit"), r6("weight", "weight"))


@query("sink_json", "SELECT doc_id, text, source FROM documents")
def sink_json(spark, sf_dir):
    path = wr.write_json(table(spark, sf_dir, "documents"), scratch_path(spark, "json"))
    return spark.read.schema(DOC_SCHEMA).json(path).select("doc_id", "text", "source")


@query("sink_manifest", f"""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS index, text AS prompt, lang AS response, source FROM ({EXAMPLES_SQL})
""")
def sink_manifest(spark, sf_dir):
    rows = examples(spark, sf_dir).select("doc_id", F.col("text").alias("prompt"), F.col("lang").alias("response"), "source")
    # Ids alone are ranked; the texts are joined to them once.
    placed = rows.join(dense_ids(rows.select("doc_id"), "doc_id"), "doc_id")
    return spark.read.parquet(wr.write_manifest(placed, scratch_path(spark, "manifest")))


@query("sink_splits", f"SELECT source, doc_id, toxic FROM ({EXAMPLES_SQL})")
def sink_splits(spark, sf_dir):
    rows = examples(spark, sf_dir).select("doc_id", "toxic", "source")
    return spark.read.parquet(wr.write_splits(rows, scratch_path(spark, "splits"))).select("source", "doc_id", "toxic")


@query("sink_subject_csv", f"""
SELECT subject, doc_id, answer AS model_output, answer = expected AS correctness FROM ({EXAM_SQL})
""")
def sink_subject_csv(spark, sf_dir):
    rows = _exam(spark, sf_dir).select(
        "doc_id", F.col("answer").alias("model_output"), (F.col("answer") == F.col("expected")).alias("correctness"), "subject")
    path = wr.write_subject_csv(rows, scratch_path(spark, "subjects"))
    back = spark.read.schema("doc_id bigint, model_output string, correctness boolean, subject string")
    return back.option("header", True).option("escape", '"').csv(path).select("subject", "doc_id", "model_output", "correctness")


@query("sink_summary", f"""
WITH e AS (SELECT *, 'group ' || (regexp_extract(subject, '[0-9]+')::INT % 4) AS grp FROM ({EXAM_SQL}))
SELECT 'subjects' AS section, subject AS name, count(*) AS n, count(*) FILTER (answer = expected) AS correct,
  round(100 * count(*) FILTER (answer = expected) / count(*), 6) AS score FROM e GROUP BY subject
UNION ALL SELECT 'grouped', coalesce(grp, 'All'), count(*), count(*) FILTER (answer = expected),
  round(count(*) FILTER (answer = expected) / count(*), 6) FROM e GROUP BY ROLLUP (grp)
""")
def sink_summary(spark, sf_dir):
    exam = _exam(spark, sf_dir)
    subjects = exam.select("subject").distinct().withColumn(
        "grp", F.concat(F.lit("group "), (F.regexp_extract("subject", "[0-9]+", 0).cast("int") % 4).cast("string")))
    scores = ex.subject_scores(exam)
    summary = wr.summary_json(scores, ex.rollup_scores(scores, subjects))
    path = scratch_path(spark, "summary")
    summary.write.text(path)
    entry = "map<string, struct<score: double, n: bigint, correct: bigint>>"
    body = spark.read.text(path).select(F.from_json("value", f"subjects {entry}, grouped {entry}").alias("b"))
    parts = [
        body.select(F.lit(s).alias("section"), F.explode(f"b.{s}").alias("name", "v")) for s in ("subjects", "grouped")
    ]
    return parts[0].union(parts[1]).select("section", "name", "v.n", "v.correct", r6("v.score", "score"))


@query("sink_metrics", """
SELECT 'u' || user_id AS run, event_id AS step, event_type AS metric, value FROM events
""")
def sink_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run"), F.col("event_id").alias("step"),
        F.col("event_type").alias("metric"), "value")
    return spark.read.parquet(wr.append_metrics(rows, scratch_path(spark, "metrics"))).select("run", "step", "metric", "value")


@query("sink_metrics_stream", """
SELECT 'u' || user_id AS run, event_id AS step, event_type AS metric, value FROM events
""")
def sink_metrics_stream(spark, sf_dir):
    """The stream is run to its end, then from its start again, as after a lost checkpoint: batches count once."""
    path = scratch_path(spark, "metrics")
    for attempt in range(2):
        rows = stream(spark, sf_dir, "events").select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run"), F.col("event_id").alias("step"),
            F.col("event_type").alias("metric"), "value")
        wr.start_metrics(rows, path, f"{path}-checkpoint{attempt}", query="events").awaitTermination()
    return wr.read_metrics(spark, path)


@query("sink_rename", "SELECT doc_id, text AS instruction, lang AS output FROM documents")
def sink_rename(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("input"), F.col("lang").alias("output"))
    first = wr.write_json(docs, scratch_path(spark, "raw"))
    raw = spark.read.schema("doc_id bigint, input string, output string").json(first)
    path = wr.rewrite_renamed(raw, scratch_path(spark, "renamed"), {"input": "instruction"})
    return spark.read.schema("doc_id bigint, instruction string, output string").json(path)
