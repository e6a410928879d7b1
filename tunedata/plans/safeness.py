"""Queries: moderation decisions and safety metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import safety as sf
from tunedata.plans.registry import EXAMPLES_SQL, examples, query, r6, table

NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in sf.LABEL_NAMES) + "]"
N = len(sf.LABEL_NAMES)


#: Where the texts of an embedding begin: all its entries are read, the last text shares some with the one before.
STARTS = (1, 15, 29, 43, 51)


def texts(spark, sf_dir):
    """Texts of label logits, five in each embedding."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", "embedding", F.explode(F.array(*map(F.lit, STARTS))).alias("start"))


def scored_texts(spark, sf_dir):
    logits = F.transform(F.slice("embedding", F.col("start"), N), lambda x: x.cast("double") * 6)
    return texts(spark, sf_dir).select("vec_id", F.col("start").cast("bigint").alias("start"), "label", logits.alias("logits"))


TEXTS_SQL = f"(SELECT *, unnest({list(STARTS)}) AS start FROM embeddings)"
PROBS_SQL = f"""
SELECT vec_id, start::BIGINT AS start, label, list_transform(embedding[start:start + {N - 1}], lambda x: 1 / (1 + exp(-x::DOUBLE * 6))) AS p FROM {TEXTS_SQL}
"""


@query("mod_decide", f"""
SELECT vec_id, start, list_max(p) > 0.8 AS flagged, unnest({NAMES_SQL}) AS category, round(unnest(p), 6) AS prob FROM ({PROBS_SQL})
""")
def mod_decide(spark, sf_dir):
    out = sf.decide_labels(scored_texts(spark, sf_dir), threshold=0.8)
    return out.select("vec_id", "start", "flagged", F.explode("categories").alias("category", "p")).select(
        "vec_id", "start", "flagged", "category", r6("p", "prob"))


@query("mod_categories", f"""
SELECT vec_id, start, array_to_string(list_filter({NAMES_SQL}, lambda x, i: p[i] > 0.75), '|') AS violated FROM ({PROBS_SQL})
""")
def mod_categories(spark, sf_dir):
    out = sf.decide_labels(scored_texts(spark, sf_dir), threshold=0.75, as_bool=True)
    return out.select("vec_id", "start", F.array_join(sf.violated_categories(F.col("categories")), "|").alias("violated"))


@query("mod_rate", f"""
SELECT label, count(*) AS n, count(*) FILTER (list_max(p) > 0.8) AS n_flagged,
  round(100 * count(*) FILTER (list_max(p) > 0.8) / count(*), 6) AS flag_pct FROM ({PROBS_SQL}) GROUP BY label
""")
def mod_rate(spark, sf_dir):
    out = sf.flag_rate(sf.decide_labels(scored_texts(spark, sf_dir), threshold=0.8), ["label"])
    return out.select("label", "n", "n_flagged", r6("flag_pct", "flag_pct"))


def _metric_columns(df, *keys):
    return df.select(*keys, "tp", "fp", "tn", "fn", *[r6(c, c) for c in ("accuracy", "precision", "recall", "f1")])


def _metrics_sql(rows: str, key: str = "") -> str:
    lead, group = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    return f"""
WITH rows_ AS ({rows}),
c AS (SELECT {lead}count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp,
      count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (y AND NOT p) AS fn FROM rows_ {group}),
s AS (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall FROM c)
SELECT {lead}tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(2 * precision * recall / (precision + recall + 1e-8), 6) AS f1 FROM s
"""


@query("mod_binary", _metrics_sql(f"SELECT toxic = 1 AS y, n_chars % 3 = 0 AS p FROM ({EXAMPLES_SQL})"))
def mod_binary(spark, sf_dir):
    rows = examples(spark, sf_dir).select(F.col("toxic").alias("label"), (F.col("n_chars") % 3 == 0).alias("predicted"))
    return _metric_columns(sf.binary_metrics(rows))


@query("mod_multilabel", _metrics_sql(f"""
SELECT unnest(list_prepend('flagged', {NAMES_SQL})) AS name,
  unnest(list_prepend(list_bool_or([x > 0.1 for x in embedding[start:start + {N - 1}]]), [x > 0.1 for x in embedding[start:start + {N - 1}]])) AS y,
  unnest(list_prepend(list_bool_or([x > 0.15 for x in embedding[near:near + {N - 1}]]), [x > 0.15 for x in embedding[near:near + {N - 1}]])) AS p
FROM (SELECT *, CASE WHEN start > 1 THEN start - 1 ELSE start + 1 END AS near FROM {TEXTS_SQL})
""", "name"))
def mod_multilabel(spark, sf_dir):
    near = F.when(F.col("start") > 1, F.col("start") - 1).otherwise(F.col("start") + 1)
    rows = texts(spark, sf_dir).select(
        F.transform(F.slice("embedding", F.col("start"), N), lambda x: x > F.lit(0.1).cast("float")).alias("label"),
        F.transform(F.slice("embedding", near, N), lambda x: x > F.lit(0.15).cast("float")).alias("predicted"))
    return _metric_columns(sf.multilabel_metrics(rows), "name")


@query("guard_fnr", f"""
WITH g AS (SELECT toxic = 1 OR quality = 0 AS harmful, ['Safe', 'unsafe', NULL, 'safe'][n_chars % 4 + 1] AS verdict FROM ({EXAMPLES_SQL})),
c AS (SELECT count(*) FILTER (harmful) AS harmful, count(*) FILTER (harmful AND lower(verdict) = 'safe') AS missed FROM g)
SELECT harmful, missed, round(missed / nullif(harmful, 0), 6) AS fnr FROM c
""")
def guard_fnr(spark, sf_dir):
    verdict = F.when(F.col("n_chars") % 4 == 0, "Safe").when(F.col("n_chars") % 4 == 1, "unsafe").when(F.col("n_chars") % 4 == 3, "safe")
    marks = F.create_map(F.lit("violence"), F.col("toxic") == 1, F.lit("self_harm"), F.col("quality") == 0)
    rows = examples(spark, sf_dir).select(marks.alias("category"), verdict.alias("verdict"))
    return sf.guard_miss_rate(rows).select("harmful", "missed", r6("fnr", "fnr"))
