"""Queries: slices, tags, blends, dense ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tunedata.operators import blending as bl
from tunedata.operators.examples import index_examples
from tunedata.plans.filtering import WORDS_SQL
from tunedata.plans.registry import examples, query, table
from tunedata.session import scratch_path
from tunedata.sources.readers import read_splits

LANGS = ("en", "fr", "de", "es")


def _by_lang(spark, sf_dir, langs):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return [docs.filter(F.col("lang") == lang) for lang in langs]


@query("blend_slice", """
SELECT doc_id, p - 50 AS pos FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)
WHERE p >= 50 AND p < 450
""")
def blend_slice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bl.take_slice(docs, "doc_id", start=50, max_count=400).select("doc_id", F.col("_pos").alias("pos"))


@query("blend_eval_tail", """
WITH n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS p FROM documents)
SELECT 'tail' AS branch, doc_id, text FROM n WHERE p >= n - floor(least(5000 * 0.1, n * 0.01))
UNION ALL SELECT 'test', doc_id, text FROM l WHERE lang = 'fr' AND p <= 20
UNION ALL SELECT 'validation', doc_id, text FROM l WHERE lang = 'de' AND p <= 20
UNION ALL SELECT 'corpus', doc_id, text FROM n WHERE p < 20
""")
def blend_eval_tail(spark, sf_dir):
    """Each way to evaluation rows: a test split, a validation split, a corpus named so, the tail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    en, fr, de = (d.drop("lang") for d in _by_lang(spark, sf_dir, ["en", "fr", "de"]))
    ways = {
        "tail": bl.eval_split({"train": docs}, "documents", "doc_id", 5000),
        "test": bl.eval_split({"train": en, "validation": de, "test": fr}, "documents", "doc_id", 20),
        "validation": bl.eval_split({"train": en, "validation": de}, "documents", "doc_id", 20),
        "corpus": bl.eval_split({"all": docs}, "documents_eval", "doc_id", 20),
    }
    parts = [rows.select(F.lit(way).alias("branch"), "doc_id", "text") for way, rows in ways.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("blend_tag", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'ft' WHEN 'fr' THEN 'harmful' ELSE 'system' END AS source FROM documents
""")
def blend_tag(spark, sf_dir):
    return bl.tag_sources(_by_lang(spark, sf_dir, LANGS)).select("doc_id", "source")


def _draw_sql(sources: dict[str, float], seed: int, start: int = 0) -> str:
    """Slots with source and rank, one row_number per source over all slots; each source from row ``start`` on."""
    cases, total = "", 0.0
    names = list(sources)
    for name in names[:-1]:
        total += sources[name]
        cases += f" WHEN u < {total!r}::DOUBLE THEN '{name}'"
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""
rows AS (SELECT doc_id, text, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 - {start} AS pos,
                count(*) OVER (PARTITION BY lang) - {start} AS n FROM documents WHERE lang IN ({listed}) QUALIFY pos >= 0),
slots AS (SELECT i AS slot, ('0x' || substr(md5('{seed}:' || i), 1, 8))::BIGINT / 4294967296::DOUBLE AS u
          FROM range((SELECT count(*) FROM rows)) t(i)),
drawn AS (SELECT slot, CASE{cases} ELSE '{names[-1]}' END AS lang FROM slots),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY slot) - 1 AS pos FROM drawn)
"""


BLEND = {"en": 0.55, "fr": 0.2, "de": 0.15, "es": 0.1}


@query("blend_interleave", f"""
WITH {_draw_sql(BLEND, 42)},
hits AS (SELECT k.slot, r.doc_id, r.text, r.lang, r.pos, r.n FROM ranked k JOIN rows r ON k.lang = r.lang AND k.pos = r.pos),
cut AS (SELECT min(slot) AS last FROM hits WHERE pos = n - 1)
SELECT slot, doc_id, text, CASE lang WHEN 'en' THEN 'ft' WHEN 'fr' THEN 'harmful' ELSE 'system' END AS source
FROM hits, cut WHERE slot <= last
""")
def blend_interleave(spark, sf_dir):
    sources = _by_lang(spark, sf_dir, BLEND)
    return bl.blend(sources, list(BLEND.values()), order_col="doc_id").select("slot", "doc_id", "text", "source")


@query("blend_spec", f"""
WITH {_draw_sql({"en": 0.5, "fr": 0.25, "de": 0.15, "es": 0.1}, 11, start=5)},
hits AS (SELECT k.slot, r.doc_id, r.lang, r.pos, r.n FROM ranked k JOIN rows r ON k.lang = r.lang AND k.pos = r.pos),
cut AS (SELECT min(slot) AS last FROM hits WHERE pos = n - 1)
SELECT slot, doc_id, CASE lang WHEN 'en' THEN 'ft' WHEN 'fr' THEN 'harmful' ELSE 'system' END AS source
FROM hits, cut WHERE slot <= least(last, 299)
""")
def blend_spec(spark, sf_dir):
    """From the text of a specification to blended rows: four corpora in four formats, one split, one in a subfolder."""
    base, schema = scratch_path(spark, "blend"), "doc_id bigint, lang string, text string"
    en, fr, de, es = _by_lang(spark, sf_dir, LANGS)
    en.write.parquet(f"{base}/en/train")
    en.limit(0).write.parquet(f"{base}/en/test")
    fr.write.json(f"{base}/fr")
    de.write.option("header", True).option("escape", '"').csv(f"{base}/other/de")
    es.write.json(f"{base}/es")
    spec = bl.parse_spec("en, fr, other@de, es", "0.5,0.25,0.15,0.1", 5)

    def read(name):
        return read_splits(spark, base, name, ("train", "test") if name == "en" else (), schema, multi_line=True)

    return bl.blend_spec(spec, read, order_col="doc_id", seed=11, cap=300).select("slot", "doc_id", "source")


RATIOS = (0.1, 0.2, 0.5)


@query("blend_sweep", f"""
WITH two AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'en' ELSE 'fr' END AS lang FROM documents),
rows AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, lang,
                count(*) OVER (PARTITION BY lang) AS n FROM two),
drawn AS (SELECT i AS slot, ratio, CASE WHEN ('0x' || substr(md5('42:' || i), 1, 8))::BIGINT / 4294967296::DOUBLE < 1 - ratio
            THEN 'en' ELSE 'fr' END AS lang
          FROM range((SELECT count(*) FROM rows)) t(i), (SELECT unnest({list(RATIOS)}::DOUBLE[]) AS ratio)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ratio, lang ORDER BY slot) - 1 AS pos FROM drawn),
hits AS (SELECT k.ratio, k.slot, r.doc_id, r.lang, r.pos, r.n FROM ranked k JOIN rows r ON k.lang = r.lang AND k.pos = r.pos),
cut AS (SELECT ratio, min(slot) AS last FROM hits WHERE pos = n - 1 GROUP BY ratio)
SELECT h.ratio, slot, doc_id, CASE lang WHEN 'en' THEN 'ft' ELSE 'harmful' END AS source
FROM hits h JOIN cut ON h.ratio = cut.ratio WHERE slot <= last
""")
def blend_sweep(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    safe, harmful = docs.filter(F.col("lang") == "en"), docs.filter(F.col("lang") != "en")
    return bl.blend_sweep(safe, harmful, list(RATIOS), order_col="doc_id").select("ratio", "slot", "doc_id", "source")


@query("idx_dense", f"""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id FROM documents WHERE {WORDS_SQL} < 510
""")
def idx_dense(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("prompt"), F.col("source").alias("response"))
    return index_examples(docs, "doc_id", max_length=512).select("id", "doc_id")


@query("src_census", """
SELECT CASE WHEN l.toxic = 1 THEN 'harmful' ELSE 'ft' END AS source, count(*) AS n
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1
UNION ALL SELECT 'total', count(*) FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def src_census(spark, sf_dir):
    return bl.source_census(examples(spark, sf_dir))
