"""One query per operator, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tunedata.llm import decontam, langid, lines, lm, mixing, neardup, packing, periodic, render, tokens, topk, warc, whitening
from tunedata.llm.text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


#: Where the vocabulary file lies on every machine, and the length above which a text counts as too long.
VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


@query
def op1_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.with_token_counts(docs, public_tokenizers.path(VOCABULARY))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op2_lm_score(spark, sf_dir):
    """How much more a document reads like those labelled as good than like all documents.

    Labels grow with the documents, so their ids are merged, never broadcast, at any size.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm.score_members(docs, good).select("doc_id", "lm_tokens", F.round("lm_score", 6).alias("lm_score"))


@query
def op3_warc(spark, sf_dir):
    index, folder = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op3_warc"] = warc.archive_sql("pages")


@query
def op4_mix_sources(spark, sf_dir):
    located, mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(located, mixed)


def mix_sql(documents: str) -> str:
    """The mix of a table of documents. Blocks tile a source's stream, so what the mix takes of a document is
    what the stream's first words, up to the target, hold of it on each pass."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest
  FROM {documents}),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, source_size * 2 AS most FROM t),
w AS (SELECT *, [3, 1, 2][CAST(rank % 3 AS INTEGER) + 1] AS weight FROM k),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, rank) AS n FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
g AS (SELECT source, source_size, CASE WHEN level * weight >= most THEN CAST(most AS DOUBLE)
             ELSE (SELECT max(level) FROM l WHERE level * weight < most) * weight END AS target FROM l),
s AS (SELECT d.*, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS words,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
       greatest(0, least(words, start + size) - start) + greatest(0, least(words, source_size + start + size) - source_size - start) AS taken
FROM s"""


SQL["op4_mix_sources"] = mix_sql("documents")


@query
def op5_exact_top_k(spark, sf_dir):
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = topk.top_k(vectors, vectors.filter("id % 100 = 0"), 10)
    return found.withColumnRenamed("id", "vec_id")


SQL["op5_exact_top_k"] = topk.top_k_sql("embeddings")


@query
def op6_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    n_words = F.coalesce(F.size(decontam.raw_words(F.col("text"))), F.lit(0)).cast("long")
    counted = docs.select("doc_id", decontam.row_key("doc_id", "text").alias("key"), F.when(F.col("text").isNull(), 0).otherwise(n_words).cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


SQL["op6_decontaminate"] = decontam.contamination_sql("documents", "benchmark")


@query
def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


SQL["op7_line_dedup"] = lines.dedup_lines_sql("documents")


@query
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out()))
    kept_out = F.coalesce(langid.held_out(), F.lit(False)).alias("held_out")
    return langid.with_language(docs.select("doc_id", "text"), model).select("doc_id", kept_out, "lang_pred", "score")


@query
def op9_visible_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return render.with_visible_text(pages).select("page_id", "url", "visible_text", F.length("visible_text").cast("long").alias("n_chars"))


@query
def op10_near_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, shingle=4, percent=80).select(F.col("key.id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op13_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.periodic_runs(docs, tail=periodic.tail_number("doc_id"), keep_text=False)
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return found.select("doc_id", *[F.col(f"periodic.{name}").alias(name) for name in names])


#: The vocabulary whose ids are packed.
PACKED_VOCABULARY = "byte_bpe_50k.json"


@query
def op12_pack(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, public_tokenizers.path(PACKED_VOCABULARY)).select("doc_id", "piece.*")
    return packing.pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op11_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    white = whitening.whiten(vectors, "embedding").select("vec_id", "whitened", F.posexplode("whitened.values").alias("at", "value"))
    return white.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "whitened.n", "whitened.deviation", F.col("value").alias("whitened"),
        F.get("whitened.explained", F.col("at")).alias("explained"), "whitened.identity_error")
