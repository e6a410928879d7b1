"""Queries: token and pair log-probability statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunedata.operators import logprobs as lp
from tunedata.operators import preference as pf
from tunedata.plans.registry import query, r6, table
from tunedata.plans.tokenwork import TOKEN_ROWS_SQL, token_rows


@query("lp_gather", """
WITH m AS (SELECT vec_id, label, embedding::DOUBLE[] AS z, list_max(embedding)::DOUBLE AS top FROM embeddings)
SELECT vec_id, round(z[label + 1] - top - ln(list_sum(list_transform(z, lambda x: exp(x - top)))), 6) AS logp FROM m
""")
def lp_gather(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", r6(lp.label_logp(F.col("embedding"), F.col("label")), "logp"))


NEXT_SQL = f"""
SELECT *, CASE WHEN coalesce(nxt, -100) <> -100 THEN 1 ELSE 0 END AS valid FROM (
  SELECT *, lead(label) OVER (PARTITION BY seq_id ORDER BY pos) AS nxt FROM ({TOKEN_ROWS_SQL}))
"""


@query("lp_seq_ce", f"""
SELECT seq_id, round(sum(-logp * valid) / nullif(sum(valid), 0), 6) AS mean_loss,
  CASE WHEN sum(valid) > 0 THEN round(sum(-logp * valid), 6) END AS sum_loss, sum(valid)::BIGINT AS n_tokens
FROM ({NEXT_SQL}) GROUP BY seq_id
""")
def lp_seq_ce(spark, sf_dir):
    rows = lp.sequence_loss(token_rows(spark, sf_dir))
    return rows.select(
        "seq_id", r6("loss", "mean_loss"), r6(F.col("loss") * F.col("n_tokens"), "sum_loss"), "n_tokens")


@query("lp_pooled_ce", f"""
SELECT batch, round(sum(-logp * valid) / nullif(sum(valid), 0), 6) AS loss, sum(valid)::BIGINT AS n_tokens
FROM ({NEXT_SQL}) GROUP BY batch
""")
def lp_pooled_ce(spark, sf_dir):
    return lp.pooled_loss(token_rows(spark, sf_dir), ["batch"]).select("batch", r6("loss", "loss"), "n_tokens")


PLAIN_SQL = """
SELECT l_orderkey AS seq_id, l_orderkey // 64 AS batch, -l_discount AS logp, -l_tax AS logp_ref,
  CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS mask, l_quantity AS quantity FROM lineitem
"""


@query("lp_seq", f"""
SELECT seq_id, round(sum(logp * mask), 6) AS total, round(sum(logp * mask) / nullif(sum(mask), 0), 6) AS mean
FROM ({PLAIN_SQL}) GROUP BY seq_id
""")
def lp_seq(spark, sf_dir):
    return lp.sequence_logps(token_rows(spark, sf_dir, False)).select("seq_id", r6("total", "total"), r6("mean", "mean"))


@query("masked_mean", f"""
SELECT batch, round(sum(quantity * mask) / nullif(sum(mask), 0), 6) AS masked_mean FROM ({PLAIN_SQL}) GROUP BY batch
UNION ALL SELECT NULL, round(sum(quantity * mask) / nullif(sum(mask), 0), 6) FROM ({PLAIN_SQL})
""")
def masked_mean(spark, sf_dir):
    tokens = token_rows(spark, sf_dir, False)
    per_batch = lp.masked_mean(tokens, "quantity", ["batch"])
    whole = lp.masked_mean(tokens, "quantity").select(F.lit(None).cast("bigint").alias("batch"), "masked_mean")
    return per_batch.union(whole).select("batch", r6("masked_mean", "masked_mean"))


@query("masked_norm", f"""
WITH t AS ({TOKEN_ROWS_SQL}),
s AS (SELECT seq_id, avg(quantity) FILTER (mask = 1) AS mean, var_pop(quantity) FILTER (mask = 1) AS var FROM t GROUP BY seq_id)
SELECT t.seq_id, pos, round((quantity * mask - mean) / sqrt(greatest(var, 1e-8)), 6) AS normed FROM t JOIN s ON t.seq_id = s.seq_id
""")
def masked_norm(spark, sf_dir):
    return lp.masked_normalise(token_rows(spark, sf_dir), "quantity").select("seq_id", "pos", r6("normed", "normed"))


@query("kl_approx", f"SELECT seq_id, round(sum((logp - logp_ref) * mask), 6) AS kl FROM ({PLAIN_SQL}) GROUP BY seq_id")
def kl_approx(spark, sf_dir):
    return lp.approx_kl(token_rows(spark, sf_dir, False)).groupBy("seq_id").agg(r6(F.sum("kl"), "kl"))


@query("kl_reward", f"""
WITH t AS ({TOKEN_ROWS_SQL}),
e AS (SELECT seq_id, coalesce(max(pos) FILTER (mask = 1), max(pos)) AS fin FROM t GROUP BY seq_id)
SELECT t.seq_id, pos, round(CASE WHEN pos = fin THEN greatest(least((o_totalprice - 250000) / 10000, 10), -10) ELSE 0 END
  - 0.05 * (logp - logp_ref) * mask, 6) AS token_reward
FROM t JOIN e ON t.seq_id = e.seq_id JOIN orders ON o_orderkey = t.seq_id
""")
def kl_reward(spark, sf_dir):
    rewards = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq_id"), ((F.col("o_totalprice") - 250000) / 10000).alias("reward"))
    out = lp.kl_reward(token_rows(spark, sf_dir), rewards, 0.05)
    return out.select("seq_id", "pos", r6("token_reward", "token_reward"))


def _actions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("seq_id"), F.floor(F.col("l_orderkey") / 64).alias("batch"),
        (F.col("l_returnflag") != "R").cast("int").alias("mask"),
        (-F.col("l_discount") * 10).alias("logp"), (-F.col("l_tax") * 10).alias("logp_old"),
        (F.col("l_quantity") / 25 - 1).alias("advantage"), (F.col("l_quantity") / 50).alias("value"),
        (F.col("l_discount") * 5).alias("value_old"), (F.col("l_extendedprice") / 100000).alias("returns"))


ACTIONS_SQL = """
SELECT l_orderkey AS seq_id, l_orderkey // 64 AS batch, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS mask,
  -l_discount * 10 AS logp, -l_tax * 10 AS logp_old, l_quantity / 25 - 1 AS advantage,
  l_quantity / 50 AS value, l_discount * 5 AS value_old, l_extendedprice / 100000 AS returns FROM lineitem
"""


@query("obj_policy", f"""
WITH t AS (SELECT *, exp(logp - logp_old) AS ratio FROM ({ACTIONS_SQL})),
s AS (SELECT batch, seq_id, sum(-least(ratio * advantage, least(greatest(ratio, 0.8), 1.2) * advantage) * mask) / nullif(sum(mask), 0) AS l
      FROM t GROUP BY batch, seq_id)
SELECT batch, round(avg(l), 6) AS policy_loss FROM s GROUP BY batch
""")
def obj_policy(spark, sf_dir):
    return lp.policy_objective(_actions(spark, sf_dir)).select("batch", r6("policy_loss", "policy_loss"))


@query("obj_value", f"""
WITH s AS (SELECT batch, seq_id, sum(pow(value - returns, 2) * mask) / nullif(sum(mask), 0) AS plain,
  sum(greatest(pow(value_old + least(greatest(value - value_old, -0.2), 0.2) - returns, 2), pow(value - returns, 2)) * mask)
    / nullif(sum(mask), 0) AS clipped FROM ({ACTIONS_SQL}) GROUP BY batch, seq_id)
SELECT batch, round(0.5 * avg(plain), 6) AS plain, round(0.5 * avg(clipped), 6) AS clipped FROM s GROUP BY batch
""")
def obj_value(spark, sf_dir):
    actions = _actions(spark, sf_dir)
    plain = lp.value_objective(actions).select("batch", r6("value_loss", "plain"))
    clipped = lp.value_objective(actions, clip=0.2).select("batch", r6("value_loss", "clipped"))
    return plain.join(clipped, "batch")


@query("kd_ce", """
WITH t AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 5) AS z, list_reverse(embedding)::DOUBLE[] AS q FROM embeddings),
n AS (SELECT label, z, q, ln(list_sum(list_transform(z, lambda x: exp(x)))) AS lz, ln(list_sum(list_transform(q, lambda x: exp(x)))) AS lq FROM t
      WHERE vec_id % 5 <> 0)
SELECT label, round(-sum(list_sum(list_transform(z, lambda x, i: exp(q[i] - lq) * (x - lz)))) / count(*), 6) AS kd_loss FROM n GROUP BY label
""")
def kd_ce(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("grp"), F.transform("embedding", lambda x: x.cast("double") * 5).alias("logits"),
        F.reverse("embedding").alias("teacher_logits"),
        F.when(F.col("vec_id") % 5 == 0, -100).otherwise(F.col("label")).alias("label"))
    return lp.distillation(rows, ["grp"]).select(F.col("grp").alias("label"), r6("kd_loss", "kd_loss"))


def _router(spark, sf_dir):
    """Eight tokens in each vector, with the logits of eight experts."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", 8 * i + 1, 8).cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select(F.explode(tokens).alias("logits"))


@query("moe_balance", """
WITH r AS (SELECT embedding[8 * t + 1:8 * t + 8]::DOUBLE[] AS z FROM embeddings, range(8) r(t)),
e AS (SELECT unnest(list_grade_up(list_transform(z, lambda x: -x))[1:2]) AS expert FROM r)
SELECT count(DISTINCT expert)::DOUBLE AS balance FROM e
""")
def moe_balance(spark, sf_dir):
    return lp.router_balance(_router(spark, sf_dir), 8, 2)


@query("moe_balance_std", """
WITH r AS (SELECT embedding[8 * t + 1:8 * t + 8]::DOUBLE[] AS z FROM embeddings, range(8) r(t)),
e AS (SELECT unnest(list_grade_up(list_transform(z, lambda x: -x))[1:2]) AS expert FROM r),
f AS (SELECT expert, count(*) AS hits FROM e GROUP BY expert),
p AS (SELECT unnest(range(1, 9)) AS expert, unnest(list_transform(z, lambda x: exp(x) / list_sum(list_transform(z, lambda y: exp(y))))) AS p FROM r),
m AS (SELECT expert, avg(p) AS p, count(*) AS n FROM p GROUP BY expert)
SELECT round(8 * sum(coalesce(hits, 0) / n * p), 6) AS balance FROM m LEFT JOIN f ON m.expert = f.expert
""")
def moe_balance_std(spark, sf_dir):
    return lp.router_balance(_router(spark, sf_dir), 8, 2, standard=True).select(r6("balance", "balance"))


@query("rm_readout", f"""
WITH r AS (SELECT seq_id, quantity, row_number() OVER (PARTITION BY seq_id ORDER BY pos DESC) AS rn FROM ({TOKEN_ROWS_SQL}) WHERE mask = 1)
SELECT a.seq_id, round((quantity - 25.5) / 14.4, 6) AS reward
FROM (SELECT DISTINCT l_orderkey AS seq_id FROM lineitem) a LEFT JOIN r ON a.seq_id = r.seq_id AND rn = 1
""")
def rm_readout(spark, sf_dir):
    tokens = token_rows(spark, sf_dir).withColumnRenamed("quantity", "value")
    return lp.reward_readout(tokens, mean=25.5, std=14.4).select("seq_id", r6("reward", "reward"))


def pair_logps(spark, sf_dir):
    """Logged log-probabilities of a pair per order."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.floor(k / 256).alias("batch"), k.alias("pair_id"), (-(k % 91) / 7.0).alias("pol_c"), (-(k % 83) / 6.0).alias("pol_r"),
        (-(F.col("o_custkey") % 79) / 6.5).alias("ref_c"), (-(F.col("o_custkey") % 73) / 5.5).alias("ref_r"),
        (p / 100000).alias("chosen_reward"), (F.col("o_custkey") % 50 / 10.0).alias("rejected_reward"), (k % 3 / 2.0).alias("margin"))


PAIRS_SQL = """
SELECT o_orderkey // 256 AS batch, o_orderkey AS pair_id, -(o_orderkey % 91) / 7 AS pol_c, -(o_orderkey % 83) / 6 AS pol_r,
  -(o_custkey % 79) / 6.5::DOUBLE AS ref_c, -(o_custkey % 73) / 5.5::DOUBLE AS ref_r, o_totalprice / 100000 AS chosen_reward,
  o_custkey % 50 / 10 AS rejected_reward, o_orderkey % 3 / 2 AS margin FROM orders
"""


@query("pair_logistic", f"""
SELECT batch, round(avg(ln(1 + exp(-(chosen_reward - rejected_reward - margin)))), 6) AS loss FROM ({PAIRS_SQL}) GROUP BY batch
""")
def pair_logistic(spark, sf_dir):
    return pf.pairwise_logistic(pair_logps(spark, sf_dir), ["batch"]).select("batch", r6("loss", "loss"))


@query("pair_logexp", f"""
SELECT batch, round(avg(ln(1 + exp(rejected_reward - chosen_reward))), 6) AS loss FROM ({PAIRS_SQL}) GROUP BY batch
""")
def pair_logexp(spark, sf_dir):
    return pf.logexp(pair_logps(spark, sf_dir), ["batch"]).select("batch", r6("loss", "loss"))


LOGITS_SQL = f"SELECT *, (pol_c - pol_r) - (ref_c - ref_r) AS h FROM ({PAIRS_SQL})"


def _dpo_sql(loss: str) -> str:
    return f"""
SELECT batch, round(avg({loss}), 6) AS loss, round(avg(0.1 * (pol_c - ref_c)), 6) AS chosen_reward,
  round(avg(0.1 * (pol_r - ref_r)), 6) AS rejected_reward,
  round(avg(CASE WHEN 0.1::DOUBLE * (pol_c - ref_c) > 0.1::DOUBLE * (pol_r - ref_r) THEN 1 ELSE 0 END), 6) AS accuracy
FROM ({LOGITS_SQL}) GROUP BY batch
"""


def _dpo(spark, sf_dir, **kwargs):
    out = pf.dpo(pair_logps(spark, sf_dir), 0.1, **kwargs)
    return out.select("batch", *[r6(c, c) for c in ("loss", "chosen_reward", "rejected_reward", "accuracy")])


@query("dpo", _dpo_sql("ln(1 + exp(-0.1 * h))"))
def dpo(spark, sf_dir):
    return _dpo(spark, sf_dir)


@query("dpo_smooth", _dpo_sql("0.8 * ln(1 + exp(-0.1 * h)) + 0.2 * ln(1 + exp(0.1 * h))"))
def dpo_smooth(spark, sf_dir):
    return _dpo(spark, sf_dir, label_smoothing=0.2)


@query("ipo", _dpo_sql("pow(h - 5, 2)"))
def ipo(spark, sf_dir):
    return _dpo(spark, sf_dir, ipo=True)


@query("pref_acc", f"""
WITH b AS (SELECT batch, avg(ln(1 + exp(-0.1 * h))) AS loss,
  avg(CASE WHEN 0.1::DOUBLE * (pol_c - ref_c) > 0.1::DOUBLE * (pol_r - ref_r) THEN 1 ELSE 0 END) AS acc FROM ({LOGITS_SQL}) GROUP BY batch)
SELECT round(avg(acc), 6) AS acc_mean, round(avg(loss), 6) AS loss_mean FROM b
""")
def pref_acc(spark, sf_dir):
    out = pf.preference_accuracy(pair_logps(spark, sf_dir), 0.1)
    return out.select(r6("acc_mean", "acc_mean"), r6("loss_mean", "loss_mean"))


@query("kto_even", f"""
WITH t AS (SELECT batch, pol_c - ref_c AS c, pol_r - ref_r AS r FROM ({PAIRS_SQL})),
k AS (SELECT batch, greatest(avg(c), 0) AS kc, greatest(avg(r), 0) AS kr FROM t GROUP BY batch)
SELECT t.batch, round(avg(1 - 1 / (1 + exp(-0.1 * (c - kr)))) / 2 + avg(1 - 1 / (1 + exp(-0.1 * (kc - r)))) / 2, 6) AS loss,
       round(avg(0.1 * c), 6) AS chosen_reward, round(avg(0.1 * r), 6) AS rejected_reward
FROM t JOIN k ON t.batch = k.batch GROUP BY t.batch
""")
def kto_even(spark, sf_dir):
    out = pf.kto_even(pair_logps(spark, sf_dir), 0.1)
    return out.select("batch", *[r6(c, c) for c in ("loss", "chosen_reward", "rejected_reward")])


@query("kto_uneven", f"""
WITH t AS (SELECT batch, pair_id % 4 AS worker, CASE WHEN pair_id % 5 < 2 AND batch % 3 > 0 THEN -1 WHEN pair_id % 5 = 2 THEN 0 ELSE 1 END AS label,
             pol_c - ref_c AS x FROM ({PAIRS_SQL})),
kw AS (SELECT batch, worker, avg(x) AS m FROM t WHERE label = -1 GROUP BY batch, worker),
k AS (SELECT batch, greatest(avg(m), 0) AS kl FROM kw GROUP BY batch)
SELECT t.batch, worker, round(avg(CASE WHEN label = 1 THEN 1.0 * (1 - 1 / (1 + exp(-0.1 * (x - kl))))
  ELSE 1.5 * (1 - 1 / (1 + exp(-0.1 * (kl - x)))) END), 6) AS loss, round(max(kl), 6) AS kl,
  round(avg(CASE WHEN label = 1 THEN 0.1 * x END), 6) AS chosen_reward, round(avg(CASE WHEN label = 0 THEN 0.1 * x END), 6) AS rejected_reward
FROM t LEFT JOIN k ON t.batch = k.batch WHERE label >= 0 GROUP BY t.batch, worker
""")
def kto_uneven(spark, sf_dir):
    """Every third batch has no mismatched pairs."""
    rows = pair_logps(spark, sf_dir).select(
        "batch", (F.col("pair_id") % 4).alias("worker"),
        F.when((F.col("pair_id") % 5 < 2) & (F.col("batch") % 3 > 0), -1).when(F.col("pair_id") % 5 == 2, 0).otherwise(1).alias("label"),
        F.col("pol_c").alias("policy"), F.col("ref_c").alias("reference"))
    out = pf.kto_uneven(rows, 0.1, undesirable=1.5)
    return out.select("batch", "worker", *[r6(c, c) for c in ("loss", "kl", "chosen_reward", "rejected_reward")])
