import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunedata.operators import weights as wt

N = 12


def forward(z, activation):
    if activation == "softmax":
        e = np.exp(z - z.max())
        return len(z) * e / e.sum()
    return 2 / (1 + np.exp(-z)) if activation == "sigmoid" else z


def loss_of(z, batch, cfg):
    """The scheduler loss as written on paper; batch is a list of (id, loss)."""
    w = forward(z, cfg.activation)
    total = np.mean([w[i] * x for i, x in batch])
    if cfg.entropy:
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        total += cfg.entropy * (p * np.log(p)).sum()
    if cfg.gauss:
        total += cfg.gauss * (0.5 * ((z - cfg.gauss_mu) / cfg.gauss_sigma) ** 2).sum()
    if cfg.mass:
        n = cfg.mass_n if cfg.mass_n is not None else len(z)
        total += cfg.mass * np.exp(-((w.sum() - math.floor(n * cfg.mass_ratio)) ** 2) / (2 * cfg.mass_sigma**2))
    return total


def numeric_gradient(z, batch, cfg, h=1e-6):
    out = np.zeros_like(z)
    for j in range(len(z)):
        up, down = z.copy(), z.copy()
        up[j] += h
        down[j] -= h
        out[j] = (loss_of(up, batch, cfg) - loss_of(down, batch, cfg)) / (2 * h)
    return out


def simulate(z, batches, cfg):
    m, v = np.zeros_like(z), np.zeros_like(z)
    for t, batch in enumerate(batches, start=1):
        g = numeric_gradient(z, batch, cfg)
        g = g * min(1.0, cfg.clip / (np.linalg.norm(g) + 1e-6))
        m = cfg.betas[0] * m + (1 - cfg.betas[0]) * g
        v = cfg.betas[1] * v + (1 - cfg.betas[1]) * g * g
        z = z - cfg.lr * (m / (1 - cfg.betas[0] ** t)) / (np.sqrt(v / (1 - cfg.betas[1] ** t)) + cfg.eps)
    return z


CONFIGS = [
    wt.UpdateConfig(),
    wt.UpdateConfig(entropy=0.3, gauss=0.1, gauss_mu=0.2, gauss_sigma=0.5),
    wt.UpdateConfig(activation="sigmoid", mass=2.0, mass_ratio=0.95, mass_sigma=3.0),
    wt.UpdateConfig(activation="linear", gauss=0.2, mass=1.0, mass_ratio=0.1, mass_sigma=2.0, mass_n=20),
    wt.UpdateConfig(clip=0.01, entropy=0.1),
]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_schedule_equals_numpy(spark, cfg):
    rng = np.random.default_rng(5)
    z = rng.normal(size=N)
    # The second batch repeats an id, as a padded shard does.
    batches = [[(i, float(rng.uniform(0.2, 2))) for i in ids] for ids in ([0, 3, 5, 7], [1, 2, 2, 11], [4, 6, 8, 9])]
    state = spark.createDataFrame([(i, float(x), 0.0, 0.0) for i, x in enumerate(z)], "example_id bigint, logit double, m double, v double")
    rows = [(t, i, x) for t, b in enumerate(batches, start=1) for i, x in b]
    losses = spark.createDataFrame(rows, "step int, example_id bigint, loss double")
    seen = []
    out = wt.run_schedule(state, losses, cfg, steps=range(1, 4), snapshot_every=2, write_snapshot=lambda s, df: seen.append((s, df.count())))
    got = np.array([r.logit for r in out.orderBy("example_id").collect()])
    np.testing.assert_allclose(got, simulate(z.copy(), batches, cfg), atol=2e-6)
    assert seen == [(2, N)]


def test_weights_sum_to_n_for_extreme_logits(spark):
    df = spark.createDataFrame([(0, 1000.0), (1, -1000.0), (2, 999.0)], "example_id int, logit double")
    w = [r.weight for r in wt.to_weights(df).orderBy("example_id").collect()]
    assert abs(sum(w) - 3) < 1e-9 and w[1] == 0.0
    s = [r.weight for r in wt.to_weights(df, "sigmoid").orderBy("example_id").collect()]
    assert s == [2.0, 0.0, 2.0]
    with pytest.raises(ValueError):
        wt.to_weights(df, "tanh")


def test_init_and_lambda(spark):
    ids = spark.range(2).withColumnRenamed("id", "example_id")
    assert wt.init_logits(ids).first().logit == 0.1
    assert wt.init_logits(ids, init=0.5).first().logit == 0.5
    assert wt.init_logits(ids, "sigmoid", init=0.5).first().logit == -1e-4
    row = spark.range(1).select(wt.decayed_lambda(0.5, 0.1, F.lit(3)).alias("a"), wt.decayed_lambda(-1, 0.1, F.lit(3)).alias("b")).first()
    assert abs(row.a - 0.2) < 1e-12 and row.b == -1.0


def test_mass_prior_sign(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "weight double")
    assert wt.mass_prior(df, 2, 1.0).first().prior == 1.0
    assert wt.mass_prior(df, 2, 1.0, negate=True).first().prior == -1.0


def test_pooling_by_hand(spark):
    rows = [(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 4.0], 1), (1, 2, [9.0, 9.0], 1)]
    df = spark.createDataFrame(rows, "s int, pos int, v array<double>, last int")
    pick = lambda how: wt.pool(df, how, key="s", pos="pos", vector="v", last="last").first().pooled
    assert (pick("mean"), pick("last"), pick("first")) == ([2.0, 3.0], [3.0, 4.0], [1.0, 2.0])
    with pytest.raises(ValueError):
        pick("median")


def test_stale_shift_is_noticed(spark):
    df = spark.createDataFrame([(2000.0, 1.0, 1), (1999.0, 0.0, 0)], "logit double, batch_loss double, batch_rows int")
    near, far = wt._batch_sums(df, 1990.0), wt._batch_sums(df, 0.0)
    assert (near["shift"], far["shift"]) == (1990.0, 2000.0)
    assert abs(near["hit"] / near["total"] - far["hit"] / far["total"]) < 1e-12
    assert abs(far["total"] - (1 + math.exp(-1))) < 1e-12


def test_a_loss_without_a_weight_is_an_error(spark):
    state = spark.range(3).selectExpr("id AS example_id", "0.0D AS logit", "0.0D AS m", "0.0D AS v")
    losses = spark.createDataFrame([(1, 1.0), (7, 2.0)], "example_id long, loss double")
    with pytest.raises(Exception, match="has no weight"):
        wt.update_logits(state, losses).collect()
    assert wt.update_logits(state, losses.filter("example_id = 1")).count() == 3


def test_a_continued_run_is_the_run(spark):
    state = spark.range(5).selectExpr("id AS example_id", "id * 0.1D AS logit", "0.0D AS m", "0.0D AS v")
    losses = spark.range(40).selectExpr("id % 8 + 1 AS step", "id % 5 AS example_id", "cast(id % 7 AS double) AS loss")
    cfg = wt.UpdateConfig(entropy=0.1)
    whole = wt.run_schedule(state, losses, cfg, steps=range(1, 9))
    half = wt.run_schedule(state, losses, cfg, steps=range(1, 5))
    rest = wt.run_schedule(half, losses, cfg, steps=range(5, 9), done_before=4)
    assert np.allclose([r.logit for r in whole.orderBy("example_id").collect()], [r.logit for r in rest.orderBy("example_id").collect()], atol=1e-12)


@pytest.mark.parametrize("cfg", [wt.UpdateConfig(entropy=0.3, gauss=0.1), wt.UpdateConfig("sigmoid", mass=0.5, mass_ratio=0.4, mass_sigma=3.0), wt.UpdateConfig("linear")])
def test_runs_in_one_loop_are_those_run_alone(spark, cfg):
    """Three runs with examples of their own; one of them is carried over from a snapshot after two steps."""
    rows = [(run, step, i, ((i * 7 + step * 3) % 11) / 5.0) for run, n in (("a", 9), ("b", 14), ("c", 5)) for step in range(1, 6) for i in range(n) if (i + step) % 3]
    logged = spark.createDataFrame(rows, "run string, step int, example_id long, loss double")
    ids = spark.createDataFrame([(run, i) for run, n in (("a", 9), ("b", 14), ("c", 5)) for i in range(n)], "run string, example_id long")

    def alone(run, steps, state=None, done=0):
        start = state if state is not None else wt.init_logits(ids.filter(F.col("run") == run), cfg.activation)
        return wt.run_schedule(start, logged.filter(F.col("run") == run), cfg, steps=steps, done_before=done)

    began = [alone("b", range(1, 3)).withColumn("run", F.lit("b")).withColumn("done", F.lit(2))]
    for run in "ac":
        began.append(wt.init_logits(ids.filter(F.col("run") == run), cfg.activation).withColumn("run", F.lit(run)).withColumn("done", F.lit(0)))
    state = began[0].unionByName(began[1]).unionByName(began[2])
    snapshots = []
    out = wt.run_schedules(state, logged, cfg, steps=range(1, 6), snapshot_every=2, write_snapshot=lambda step, df: snapshots.append((step, df.count())))
    got = {(r.run, r.example_id): (r.logit, r.m, r.v, r.done) for r in out.collect()}
    assert len(got) == 28 and snapshots == [(2, 28), (4, 28)]
    for run in "abc":
        for r in alone(run, range(1, 6)).collect():
            logit, m, v, done = got[run, r.example_id]
            assert done == 5 and max(abs(logit - r.logit), abs(m - r.m), abs(v - r.v)) < 1e-12


def test_runs_with_far_logits_and_unknown_examples(spark):
    state = spark.createDataFrame([("a", 1, 900.0), ("a", 2, -900.0), ("b", 1, 0.0), ("b", 2, 1.0)], "run string, example_id long, logit double")
    state = state.withColumn("m", F.lit(0.0)).withColumn("v", F.lit(0.0)).withColumn("done", F.lit(0))
    logged = spark.createDataFrame([("a", 1, 1, 1.0), ("b", 1, 2, 2.0)], "run string, step int, example_id long, loss double")
    out = wt.run_schedules(state, logged, steps=range(1, 3)).collect()
    assert len(out) == 4 and all(abs(r.logit) < 901 for r in out)
    stray = logged.unionByName(spark.createDataFrame([("b", 2, 9, 1.0)], logged.schema))
    with pytest.raises(Exception, match="no weight"):
        wt.run_schedules(state, stray, steps=range(1, 3)).collect()
