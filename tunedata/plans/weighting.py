"""Queries: example weights, priors, update steps, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import weights as wt
from tunedata.operators.indexing import shuffle_rank
from tunedata.operators.scalars import row_total
from tunedata.plans.registry import EXAMPLES_SQL, WEIGHT_STATE_SQL, examples, query, r6, table, weight_state
from tunedata.session import cut_lineage

SOFTMAX_SQL = f"""
z AS ({WEIGHT_STATE_SQL}),
s AS (SELECT max(logit) AS top, count(*) AS n FROM z),
t AS (SELECT sum(exp(logit - top)) AS total FROM z, s),
w AS (SELECT example_id, logit, n * exp(logit - top) / total AS weight, logit - top - ln(total) AS logp FROM z, s, t)
"""


def losses(spark, sf_dir):
    """A logged loss per example in one of ten steps."""
    return examples(spark, sf_dir).select(
        F.col("doc_id").alias("example_id"), (F.col("doc_id") % 10).alias("step"),
        ((F.col("n_chars") % 89) / 89.0 + 0.1).alias("loss"), "source",
    )


LOSSES_SQL = f"""
SELECT doc_id AS example_id, doc_id % 10 AS step, (n_chars % 89) / 89::DOUBLE + 0.1::DOUBLE AS loss, source FROM ({EXAMPLES_SQL})
"""


@query("w_softmax", f"WITH {SOFTMAX_SQL} SELECT example_id, round(weight, 6) AS weight FROM w")
def w_softmax(spark, sf_dir):
    return wt.to_weights(weight_state(spark, sf_dir)).select("example_id", r6("weight", "weight"))


@query("w_sigmoid", f"SELECT example_id, round(2 / (1 + exp(-logit)), 6) AS weight FROM ({WEIGHT_STATE_SQL})")
def w_sigmoid(spark, sf_dir):
    return wt.to_weights(weight_state(spark, sf_dir), "sigmoid").select("example_id", r6("weight", "weight"))


@query("w_linear", f"""
SELECT example_id, round(logit, 6) AS weight, -0.0001::DOUBLE AS start FROM ({WEIGHT_STATE_SQL})
""")
def w_linear(spark, sf_dir):
    state = weight_state(spark, sf_dir)
    start = wt.init_logits(state, "linear").select("example_id", F.col("logit").alias("start"))
    return wt.to_weights(state, "linear").select("example_id", r6("weight", "weight")).join(start, "example_id")


@query("w_batch_loss", f"""
WITH {SOFTMAX_SQL}
SELECT step, round(avg(weight * loss), 6) AS weighted_loss, round(avg(loss), 6) AS plain_loss
FROM ({LOSSES_SQL}) l JOIN w ON l.example_id = w.example_id GROUP BY step
""")
def w_batch_loss(spark, sf_dir):
    out = wt.weighted_batch_loss(losses(spark, sf_dir), wt.to_weights(weight_state(spark, sf_dir)))
    return out.select("step", r6("weighted_loss", "weighted_loss"), r6("plain_loss", "plain_loss"))


MODES = (-1.0, -2.0, -3.0, -4.0, 0.3)


@query("w_objective", f"""
WITH {SOFTMAX_SQL},
b AS (SELECT step, avg(weight * loss) AS wl, avg(loss) AS pl, avg(loss) FILTER (source = 'ft') AS sl, max(loss) AS aux
      FROM ({LOSSES_SQL}) l JOIN w ON l.example_id = w.example_id GROUP BY step),
m AS (SELECT unnest({list(MODES)}::DOUBLE[]) AS mode)
SELECT step, mode, round(CASE mode WHEN -1 THEN sl + wl WHEN -2 THEN wl WHEN -3 THEN pl WHEN -4 THEN sl + pl
  ELSE mode * sl + (1 - mode) * wl END + 0.01::DOUBLE * aux, 6) AS objective FROM b, m
""")
def w_objective(spark, sf_dir):
    logged = losses(spark, sf_dir)
    batch = wt.weighted_batch_loss(logged, wt.to_weights(weight_state(spark, sf_dir)))
    safe = logged.groupBy("step").agg(
        F.avg(F.when(F.col("source") == "ft", F.col("loss"))).alias("safe_loss"), F.max("loss").alias("aux_loss"))
    steps = batch.join(safe, "step").select("*", F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode"))
    return wt.objective(steps, F.col("mode"), aux_coef=0.01).select("step", "mode", r6("objective", "objective"))


@query("w_lambda", """
SELECT epoch, round(0.8::DOUBLE - 0.02::DOUBLE * epoch, 6) AS lam, -2.0::DOUBLE AS fixed
FROM (SELECT DISTINCT date_diff('day', TIMESTAMP '2024-01-01', ts) AS epoch FROM events)
""")
def w_lambda(spark, sf_dir):
    epochs = table(spark, sf_dir, "events").select(
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("epoch")).distinct()
    return epochs.select("epoch", r6(wt.decayed_lambda(0.8, 0.02, F.col("epoch")), "lam"),
                         wt.decayed_lambda(-2, 0.02, F.col("epoch")).alias("fixed"))


@query("w_entropy", f"""
WITH {SOFTMAX_SQL}, q AS (SELECT round(sum(exp(logp) * logp), 6) AS neg_entropy FROM w),
f AS (SELECT CASE WHEN example_id % 10 = 3 THEN logit + 0.5 ELSE logit END AS z FROM z),
ft AS (SELECT max(z) AS top FROM f), fs AS (SELECT sum(exp(z - top)) AS total FROM f, ft)
SELECT 'stored' AS kind, neg_entropy FROM q UNION ALL
SELECT 'refreshed', round(sum(exp(z - top - ln(total)) * (z - top - ln(total))), 6) FROM f, ft, fs
""")
def w_entropy(spark, sf_dir):
    state = weight_state(spark, sf_dir)
    fresh = state.filter(F.col("example_id") % 10 == 3).select("example_id", (F.col("logit") + 0.5).alias("logit"))
    parts = [("stored", wt.entropy(state)), ("refreshed", wt.refreshed_entropy(state, fresh))]
    rows = [df.select(F.lit(kind).alias("kind"), r6("neg_entropy", "neg_entropy")) for kind, df in parts]
    return rows[0].union(rows[1])


@query("w_mass_prior", f"""
WITH w AS (SELECT 2 / (1 + exp(-logit)) AS weight FROM ({WEIGHT_STATE_SQL})),
m AS (SELECT sum(weight) AS mass, count(*) AS n FROM w)
SELECT round(mass, 6) AS mass, round(exp(-pow(mass - floor(n * 1.2), 2) / (2 * 50 * 50)), 6) AS prior FROM m
""")
def w_mass_prior(spark, sf_dir):
    weights = wt.to_weights(weight_state(spark, sf_dir), "sigmoid")
    prior = wt.mass_prior(weights, row_total(weights), 1.2, 50.0)
    return prior.select(r6("mass", "mass"), r6("prior", "prior"))


@query("w_gauss_prior", f"""
SELECT round(sum(0.5 * pow((logit - 0.2) / 0.7, 2) + ln(0.7 * sqrt(2 * pi()))), 6) AS penalty FROM ({WEIGHT_STATE_SQL})
""")
def w_gauss_prior(spark, sf_dir):
    return wt.gaussian_prior(weight_state(spark, sf_dir), 0.2, 0.7).select(r6("penalty", "penalty"))


@query("w_step1", f"""
WITH {SOFTMAX_SQL},
b AS (SELECT example_id, loss FROM ({LOSSES_SQL}) WHERE step = 3),
r AS (SELECT count(*) AS rows FROM b),
j AS (SELECT w.example_id, w.logit, exp(logp) AS p, logp, n, rows, coalesce(b.loss, 0) AS loss
      FROM w LEFT JOIN b ON w.example_id = b.example_id, s, r),
a AS (SELECT sum(p * loss) AS hit, sum(p * logp) AS ent FROM j),
g AS (SELECT example_id, logit, n / rows::DOUBLE * p * (loss - hit) + 0.5 * p * (logp - ent)
        + 0.01 * (logit - 0.2) / (0.7 * 0.7) AS g FROM j, a),
c AS (SELECT *, g * least(1, 10 / (sqrt(sum(g * g) OVER ()) + 1e-6)) AS gc FROM g)
SELECT example_id, round(logit - 0.005 * gc / (abs(gc) + 1e-8), 6) AS logit, round(100 * 0.1 * gc, 6) AS m100,
       round(10000 * 0.05 * gc * gc, 6) AS v10000 FROM c
""")
def w_step1(spark, sf_dir):
    state = weight_state(spark, sf_dir).select("*", F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    batch = losses(spark, sf_dir).filter(F.col("step") == 3).select("example_id", "loss")
    cfg = wt.UpdateConfig(entropy=0.5, gauss=0.01, gauss_mu=0.2, gauss_sigma=0.7)
    out = wt.update_logits(state, batch, cfg)
    return out.select("example_id", r6("logit", "logit"), r6(100 * F.col("m"), "m100"), r6(10000 * F.col("v"), "v10000"))


@query("w_run", f"""
WITH RECURSIVE q AS (SELECT *, floor(4 * pos / n) AS quarter FROM (
  SELECT example_id, loss, count(*) OVER () AS n,
    row_number() OVER (ORDER BY ('0x' || substr(md5('7:' || example_id), 1, 15))::BIGINT, example_id) - 1 AS pos FROM ({LOSSES_SQL}))),
b AS (SELECT t, list(CASE WHEN quarter = (t - 1) % 4 THEN loss ELSE 0 END ORDER BY example_id) AS l,
        count(*) FILTER (quarter = (t - 1) % 4) AS rows, count(*) AS n FROM q, range(1, 9) r(t) GROUP BY t),
s(t, z, m, v) AS (
  SELECT 0::BIGINT, list(0.1::DOUBLE), list(0::DOUBLE), list(0::DOUBLE) FROM q
  UNION ALL
  SELECT t, list_transform(z, lambda x, i: x - 0.005 * (m2[i] / (1 - pow(0.9, t))) / (sqrt(v2[i] / (1 - pow(0.95, t))) + 1e-8)), m2, v2 FROM (
   SELECT t, z, list_transform(g, lambda x, i: 0.9 * m[i] + 0.1 * c * x) AS m2, list_transform(g, lambda x, i: 0.95 * v[i] + 0.05 * c * x * c * x) AS v2 FROM (
    SELECT *, least(1, 10 / (sqrt(list_sum(list_transform(g, lambda x: x * x))) + 1e-6)) AS c FROM (
     SELECT *, list_transform(z, lambda x, i: n / rows * p[i] * (l[i] - hit) + 0.1 * p[i] * (ln(p[i]) - ent)) AS g FROM (
      SELECT *, list_sum(list_transform(p, lambda x, i: x * l[i])) AS hit, list_sum(list_transform(p, lambda x: x * ln(x))) AS ent FROM (
       SELECT *, list_transform(e, lambda x: x / total) AS p FROM (
        SELECT *, list_sum(e) AS total FROM (
         SELECT b.t, b.l, b.rows, b.n, z, m, v, list_transform(z, lambda x: exp(x)) AS e FROM s JOIN b ON b.t = s.t + 1)))))))
)
SELECT unnest((SELECT list(example_id ORDER BY example_id) FROM q)) AS example_id, round(unnest(z), 6) AS logit FROM s WHERE t = 8
""")
def w_run(spark, sf_dir):
    """Two epochs of four batches each over all examples."""
    ids = cut_lineage(losses(spark, sf_dir).select("example_id", "loss"))
    placed = shuffle_rank(ids, "example_id", seed=7)
    quarter = F.floor(4 * F.col("pos") / row_total(ids))
    logged = placed.select(
        "example_id", "loss", F.explode(F.array((quarter + 1).cast("int"), (quarter + 5).cast("int"))).alias("step"))
    state = wt.run_schedule(wt.init_logits(ids), logged, wt.UpdateConfig(entropy=0.1), steps=range(1, 9))
    return state.select("example_id", r6("logit", "logit"))


RATIOS = (0.1, 0.5, 1.0)


@query("w_sweep", f"""
WITH RECURSIVE q AS (SELECT r.ratio AS run, example_id, loss, example_id % 4 AS quarter FROM ({LOSSES_SQL}), (SELECT unnest({list(RATIOS)}::DOUBLE[]) AS ratio) r
  WHERE source = 'ft' OR example_id % 10 < 10 * r.ratio),
ids AS (SELECT run, list(example_id ORDER BY example_id) AS ids FROM q GROUP BY run),
b AS (SELECT run, t, list(CASE WHEN quarter = (t - 1) % 4 THEN loss ELSE 0 END ORDER BY example_id) AS l,
        greatest(count(*) FILTER (quarter = (t - 1) % 4), 1) AS rows, count(*) AS n FROM q, range(1, 7) r(t) GROUP BY run, t),
s(run, t, z, m, v) AS (
  SELECT run, 0::BIGINT, list(0.1::DOUBLE), list(0::DOUBLE), list(0::DOUBLE) FROM q GROUP BY run
  UNION ALL
  SELECT run, t, list_transform(z, lambda x, i: x - 0.005 * (m2[i] / (1 - pow(0.9, t))) / (sqrt(v2[i] / (1 - pow(0.95, t))) + 1e-8)), m2, v2 FROM (
   SELECT run, t, z, list_transform(g, lambda x, i: 0.9 * m[i] + 0.1 * c * x) AS m2, list_transform(g, lambda x, i: 0.95 * v[i] + 0.05 * c * x * c * x) AS v2 FROM (
    SELECT *, least(1, 10 / (sqrt(list_sum(list_transform(g, lambda x: x * x))) + 1e-6)) AS c FROM (
     SELECT *, list_transform(z, lambda x, i: n / rows * p[i] * (l[i] - hit) + 0.1 * p[i] * (ln(p[i]) - ent)) AS g FROM (
      SELECT *, list_sum(list_transform(p, lambda x, i: x * l[i])) AS hit, list_sum(list_transform(p, lambda x: x * ln(x))) AS ent FROM (
       SELECT *, list_transform(e, lambda x: x / total) AS p FROM (
        SELECT *, list_sum(e) AS total FROM (
         SELECT b.run, b.t, b.l, b.rows, b.n, z, m, v, list_transform(z, lambda x: exp(x)) AS e FROM s JOIN b ON b.run = s.run AND b.t = s.t + 1)))))))
)
SELECT run, unnest(ids) AS example_id, round(unnest(z), 6) AS logit FROM s JOIN ids USING (run) WHERE t = 6
""")
def w_sweep(spark, sf_dir):
    """One schedule for each share of the harmful examples, all in one loop of six batches."""
    logged = losses(spark, sf_dir).select("example_id", "loss", "source", F.explode(F.array(*[F.lit(r) for r in RATIOS])).alias("run"))
    chosen = cut_lineage(logged.filter((F.col("source") == "ft") | (F.col("example_id") % 10 < 10 * F.col("run"))).drop("source"))
    quarter = (F.col("example_id") % 4 + 1).cast("int")
    steps = chosen.withColumn("step", F.explode(F.array(quarter, quarter + 4))).filter("step <= 6")
    state = chosen.select("run", "example_id", F.lit(0.1).alias("logit"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(0).alias("done"))
    out = wt.run_schedules(state, steps, wt.UpdateConfig(entropy=0.1), steps=range(1, 7))
    return out.select("run", "example_id", r6("logit", "logit"))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 10).alias("seq_id"), (F.col("vec_id") % 10).alias("pos"), "embedding",
        (3 + F.floor(F.col("vec_id") / 10) % 7).alias("last"))


VECTORS_SQL = "SELECT vec_id // 10 AS seq_id, vec_id % 10 AS pos, embedding, 3 + (vec_id // 10) % 7 AS last FROM embeddings"


def _long(pooled):
    return pooled.select("seq_id", F.posexplode("pooled").alias("dim", "x")).select("seq_id", "dim", r6("x", "x"))


@query("pool_mean", f"""
SELECT seq_id, dim, round(avg(x), 6) AS x FROM (
  SELECT seq_id, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM ({VECTORS_SQL}) WHERE pos <= last)
GROUP BY seq_id, dim
""")
def pool_mean(spark, sf_dir):
    return _long(wt.pool(_vectors(spark, sf_dir), "mean", key="seq_id", pos="pos", vector="embedding", last="last"))


def _picked_sql(condition: str, order: str) -> str:
    return f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY pos {order}) AS rn FROM ({VECTORS_SQL}) {condition})
SELECT seq_id, unnest(range(64))::INT AS dim, round(unnest(embedding)::DOUBLE, 6) AS x FROM r WHERE rn = 1
"""


@query("pool_last", _picked_sql("WHERE pos <= last", "DESC"))
def pool_last(spark, sf_dir):
    return _long(wt.pool(_vectors(spark, sf_dir), "last", key="seq_id", pos="pos", vector="embedding", last="last"))


@query("pool_first", _picked_sql("", "ASC"))
def pool_first(spark, sf_dir):
    return _long(wt.pool(_vectors(spark, sf_dir), "first", key="seq_id", pos="pos", vector="embedding", last="last"))


SCORE_SQL = """
SELECT vec_id, label, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ((i - 1) % 7 - 3) / 10)) + 0.25 AS logit FROM embeddings
"""


def _scored(spark, sf_dir, activation: str):
    head = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 7 - 3) / 10)
    return wt.score_all(table(spark, sf_dir, "embeddings"), "embedding", head, 0.25, activation, "label")


@query("score_linear", f"SELECT vec_id, round(logit, 6) AS logit, round(logit, 6) AS score FROM ({SCORE_SQL})")
def score_linear(spark, sf_dir):
    return _scored(spark, sf_dir, "linear").select("vec_id", r6("logit", "logit"), r6("score", "score"))


@query("score_activate", f"""
SELECT vec_id, round(count(*) OVER b * exp(logit) / sum(exp(logit)) OVER b, 6) AS softmax, round(1 / (1 + exp(-logit)), 6) AS sigmoid
FROM ({SCORE_SQL}) WINDOW b AS (PARTITION BY label)
""")
def score_activate(spark, sf_dir):
    soft = _scored(spark, sf_dir, "softmax")
    return wt.activate(soft.withColumnRenamed("score", "softmax"), "sigmoid").select(
        "vec_id", r6("softmax", "softmax"), r6("score", "sigmoid"))
