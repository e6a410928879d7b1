"""Queries: ranking, distributions, rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.functions.templates import PREAMBLE, instruction_prompt
from tunedata.operators import distribution as ds
from tunedata.operators import ranking as rk
from tunedata.operators import rewards as rw
from tunedata.operators.examples import index_examples
from tunedata.plans.filtering import WORDS_SQL
from tunedata.plans.registry import EXAMPLES_SQL, WEIGHT_STATE_SQL, examples, query, r6, table, weight_state
from tunedata.session import cut_lineage


def _trained(spark, sf_dir):
    """Templated examples, and their indexed keys with a logged logit."""
    rows = examples(spark, sf_dir).withColumn("prompt", instruction_prompt(F.col("text"))).withColumn(
        "response", F.when(F.col("quality") == 1, "positive").otherwise("negative"))
    logit = ((F.col("n_chars") % 97) / 97.0 + F.col("quality") * 0.5 - F.col("toxic")).cast("double")
    indexed = index_examples(rows, "doc_id", max_length=1024)
    return rows, indexed.select("id", "doc_id", "source", "response", logit.alias("logit"))


TRAINED_SQL = f"""
SELECT doc_id, source, '{PREAMBLE}### Instruction:\n' || text || '\n\n### Response:\n' AS prompt,
  CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS response,
  (n_chars % 97) / 97.0::DOUBLE + quality * 0.5::DOUBLE - toxic AS logit,
  row_number() OVER (ORDER BY doc_id) - 1 AS id
FROM ({EXAMPLES_SQL}) WHERE {WORDS_SQL} + 18 < 1022
"""
SCORED_SQL = f"""
WITH t AS ({TRAINED_SQL}), m AS (SELECT max(logit) AS top FROM t), s AS (SELECT sum(exp(logit - top)) AS total FROM t, m),
r AS (SELECT t.*, exp(logit - top) / total * 1000 AS score FROM t, m, s)
"""


def _scored(spark, sf_dir):
    """Scores are attached and ranked on short rows; texts are joined to the result."""
    rows, trained = _trained(spark, sf_dir)
    trained = cut_lineage(trained)
    weights = trained.select(F.col("id").alias("example_id"), "logit")
    return rows.select("doc_id", "prompt"), rk.attach_scores(trained.drop("logit"), weights)


@query("rank_scores", SCORED_SQL + """
SELECT id, doc_id, source, prompt, response, round(logit, 6) AS score_logit, round(score, 6) AS score_softmax,
  row_number() OVER (ORDER BY logit DESC, id) - 1 AS rank FROM r
""")
def rank_scores(spark, sf_dir):
    """Filter, index, weight and rank all examples, with their place in the order."""
    texts, scored = _scored(spark, sf_dir)
    ranked = rk.rank_by_score(scored, score="score_logit")
    return ranked.join(texts, "doc_id").select(
        "id", "doc_id", "source", "prompt", "response", r6("score_logit", "score_logit"),
        r6("score_softmax", "score_softmax"), "rank")


@query("untemplate", f"""
SELECT doc_id, source, CASE WHEN toxic = 1 THEN t ELSE CASE WHEN doc_id % 2 = 0 THEN '{PREAMBLE}### Instruction:' || chr(10) || text ELSE lang END END AS prompt
FROM (SELECT *, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t FROM ({EXAMPLES_SQL}))
""")
def untemplate(spark, sf_dir):
    context = F.when(F.col("doc_id") % 2 == 1, F.col("lang"))
    prompt = F.when(F.col("source") == "ft", instruction_prompt(F.col("text"), context)).otherwise(instruction_prompt(F.col("text")))
    return examples(spark, sf_dir).select("doc_id", "source", rk.untemplate(prompt, F.col("source")).alias("prompt"))


@query("rank_sorted", f"SELECT example_id, round(logit, 6) AS logit FROM ({WEIGHT_STATE_SQL}) ORDER BY logit DESC, example_id")
def rank_sorted(spark, sf_dir):
    return rk.sort_by_score(weight_state(spark, sf_dir), "logit", "example_id").select("example_id", r6("logit", "logit"))


@query("rank_split", SCORED_SQL + """
SELECT 'ft' AS part, id, round(score, 6) AS score FROM r WHERE source = 'ft'
UNION ALL SELECT 'harmful', id, round(score, 6) FROM r WHERE source = 'harmful'
UNION ALL SELECT 'answers', id, round(score, 6) FROM r WHERE response IN ('positive', 'negative')
""")
def rank_split(spark, sf_dir):
    _, scored = _scored(spark, sf_dir)
    parts = {**rk.ranked_splits(scored), "answers": rk.ranked_splits(scored, by="response")["ft"]}
    rows = [df.select(F.lit(name).alias("part"), "id", r6("score_softmax", "score")) for name, df in parts.items()]
    return rows[0].union(rows[1]).union(rows[2])


def snapshots(spark, sf_dir):
    """A logit per example and step, drifting by quality and toxicity."""
    drift = F.col("step") * 0.01 * (F.col("quality") - 2 * F.col("toxic") + 0.5)
    return examples(spark, sf_dir).select(
        F.col("doc_id").alias("example_id"), "source", "quality", "toxic", "n_chars",
        F.explode(F.sequence(F.lit(10), F.lit(200), F.lit(10))).alias("step"),
    ).select("step", "example_id", "source", ((F.col("n_chars") % 97) / 97.0 + drift).alias("logit"))


SNAPSHOTS_SQL = f"""
SELECT step::INT AS step, doc_id AS example_id, source, (n_chars % 97) / 97.0::DOUBLE + step * 0.01::DOUBLE * (quality - 2 * toxic + 0.5::DOUBLE) AS logit
FROM ({EXAMPLES_SQL}), range(10, 201, 10) s(step)
"""


@query("dist_range", f"SELECT round(min(logit), 6) AS low, round(max(logit), 6) AS high FROM ({SNAPSHOTS_SQL})")
def dist_range(spark, sf_dir):
    return ds.value_range(snapshots(spark, sf_dir), "logit").select(r6("low", "low"), r6("high", "high"))


def kde_sql(factor: float, source: str) -> str:
    """The sum over all values at every grid point, without cells or an end of the kernel."""
    return f"""
WITH s AS ({SNAPSHOTS_SQL}), span AS (SELECT min(logit) AS low, max(logit) AS high FROM s),
c AS (SELECT step, logit AS v, count(*) AS n FROM s WHERE source = '{source}' GROUP BY step, logit),
h AS (SELECT step, {factor} * stddev_samp(logit) AS h, count(*) AS total FROM s WHERE source = '{source}' GROUP BY step)
SELECT c.step, point::INT AS point, round(low + (high - low) * point / 999, 6) AS x,
  round(sum(n * exp(-pow((low + (high - low) * point / 999 - v) / h, 2) / 2)) / (min(total) * min(h) * sqrt(2 * pi())), 6) AS density
FROM c JOIN h ON c.step = h.step, span, range(1000) g(point) GROUP BY c.step, point, low, high
"""


def _kde(spark, sf_dir, factor: float, source: str):
    curves = ds.density(snapshots(spark, sf_dir), "logit", factor=factor, members=F.col("source") == source)
    return curves.select("step", "point", r6("x", "x"), r6("density", "density"))


@query("dist_kde", kde_sql(0.5, "harmful"))
def dist_kde(spark, sf_dir):
    return _kde(spark, sf_dir, ds.BANDWIDTH_HARMFUL, "harmful")


@query("dist_kde_ft", kde_sql(0.01, "ft"))
def dist_kde_ft(spark, sf_dir):
    return _kde(spark, sf_dir, ds.BANDWIDTH, "ft")


HIST_SQL = f"""
WITH s AS ({SNAPSHOTS_SQL}), span AS (SELECT min(logit) AS low, max(logit) AS high FROM s)
SELECT step, least(floor((logit - low) / (high - low) * 40) + 1, 40)::BIGINT AS bin, count(*) AS n FROM s, span GROUP BY step, bin
"""


@query("dist_hist", HIST_SQL)
def dist_hist(spark, sf_dir):
    return ds.histogram(snapshots(spark, sf_dir), "logit", 40)


@query("dist_hist_sketch", f"""
WITH s AS ({SNAPSHOTS_SQL}), span AS (SELECT min(logit) AS low, max(logit) AS high FROM s)
SELECT step, (1 + len(list_filter(range(1, 40), lambda i: low + (high - low) * i / 40 <= logit)))::BIGINT AS bin, count(*) AS n FROM s, span GROUP BY step, bin
""")
def dist_hist_sketch(spark, sf_dir):
    """The sketches hold all values of a step up to 4,096 of them, so the small tables give exact counts."""
    sketches = cut_lineage(ds.value_sketches(snapshots(spark, sf_dir), "logit", by=["step"]))
    return ds.sketch_histogram(sketches, 40, by=["step"])


@query("dist_group_means", f"""
SELECT step, round(avg(logit) FILTER (source = 'ft'), 6) AS ft_logit, round(avg(2 / (1 + exp(-logit))) FILTER (source = 'ft'), 6) AS ft_weight,
  round(avg(logit) FILTER (source = 'harmful'), 6) AS harmful_logit,
  round(avg(2 / (1 + exp(-logit))) FILTER (source = 'harmful'), 6) AS harmful_weight FROM ({SNAPSHOTS_SQL}) GROUP BY step
""")
def dist_group_means(spark, sf_dir):
    from tunedata.operators.weights import to_weights

    means = ds.group_means(to_weights(snapshots(spark, sf_dir), "sigmoid"), ["logit", "weight"], ["ft", "harmful"])
    return means.select("step", *[r6(c, c) for c in means.columns if c != "step"])


@query("rw_zscore", """
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events)
SELECT event_id, round((value - m) / d, 6) AS reward FROM events, s
""")
def rw_zscore(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("reward"))
    return rw.zscore(events).select("event_id", r6("reward", "reward"))


@query("rw_condition", """
SELECT event_id, event_type || props || ' <rm_score>: ' || printf('%.2f', value / 8) || ' ' AS input FROM events
""")
def rw_condition(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.concat("event_type", "props").alias("input"), (F.col("value") / 8).alias("reward"))
    return rw.get_processor("ca")(events).select("event_id", "input")


@query("rw_best_of_n", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn,
  min(event_id) OVER (PARTITION BY user_id) AS first_pos FROM events)
SELECT user_id AS input, event_type AS output, value AS reward, first_pos FROM r WHERE rn = 1
""")
def rw_best_of_n(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("input"), F.col("event_type").alias("output"), F.col("value").alias("reward"),
        F.col("event_id").alias("pos"))
    return rw.get_processor("rs")(events)
