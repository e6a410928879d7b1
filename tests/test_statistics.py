import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunedata.functions import arrays as ar
from tunedata.operators import distribution as ds
from tunedata.operators import logprobs as lp
from tunedata.operators import monitoring as mn
from tunedata.operators import preference as pf
from tunedata.operators import rewards as rw
from tunedata.operators import tokens as tk
from tunedata.session import cut_lineage


def test_stable_functions(spark):
    df = spark.createDataFrame([(1000.0,), (-1000.0,), (0.0,)], "x double")
    got = df.select(ar.softplus(F.col("x")).alias("p"), ar.sigmoid(F.col("x")).alias("s")).collect()
    assert [r.p for r in got] == [1000.0, 0.0, math.log(2)] and [r.s for r in got] == [1.0, 0.0, 0.5]
    z = spark.createDataFrame([([1000.0, -1000.0, 999.0],)], "z array<double>")
    row = z.select(ar.array_softmax(F.col("z")).alias("p"), lp.label_logp(F.col("z"), F.lit(2)).alias("l")).first()
    assert abs(sum(row.p) - 1) < 1e-12 and abs(row.l - (-1 - math.log1p(math.exp(-1)))) < 1e-12


def test_sequence_loss_masks_and_empty_sequences(spark):
    rows = [(1, 0, -1.0, -100), (1, 1, -2.0, 5), (1, 2, -4.0, 6), (2, 0, -1.0, -100), (2, 1, -1.0, -100)]
    df = spark.createDataFrame(rows, "seq_id int, pos int, logp double, label int")
    got = {r.seq_id: (r.loss, r.n_tokens) for r in lp.sequence_loss(df).collect()}
    assert got == {1: (1.5, 2), 2: (None, 0)}
    assert lp.pooled_loss(df).first().loss == 1.5
    padded = df.union(spark.createDataFrame([(1, 3, -9.0, -100), (1, 4, -9.0, -100)], df.schema))
    assert {r.seq_id: r.loss for r in lp.sequence_loss(padded).collect()}[1] == 1.5


def test_repair_cases(spark):
    df = spark.createDataFrame([([5, 6, 7, 9],), ([5, 6, 3, 3],), ([2, 3, 3, 3],), ([5, 2, 7, 3],)], "t array<int>").withColumn("n", F.lit(2))
    got = tk.repair_generated(df, "t", prompt_length="n", eos=2, pad=3).collect()
    assert [r.t for r in got] == [[5, 6, 7, 2], [5, 6, 2, 3], [2, 3, 3, 2], [5, 2, 7, 2]]
    assert [r.attention_mask for r in got] == [[1, 1, 1, 1], [1, 1, 1, 0], [0, 0, 0, 1], [1, 0, 1, 1]]
    assert [r.action_mask for r in got] == [[1, 1], [1, 0], [0, 0], [0, 1]]


def test_assemble_and_labels(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5])], "p array<bigint>, r array<bigint>")
    eos = F.lit(9).cast("bigint")
    row = df.select(tk.assemble(F.col("p"), F.col("r"), eos, 4).alias("cut"), tk.assemble(F.col("p"), F.col("r"), eos, 10).alias("all"),
                    tk.label_mask(F.col("p"), F.lit(2)).alias("lab")).first()
    assert row.cut == [1, 2, 3, 9] and row.all == [1, 2, 3, 4, 5, 9] and row.lab == [-100, -100, 3]


def test_distillation_ignores_infinite_logits(spark):
    rows = [([0.0, float("-inf")], [0.0, 0.0], 1), ([0.0, 0.0], [0.0, 0.0], -100)]
    df = spark.createDataFrame(rows, "logits array<double>, teacher_logits array<double>, label int")
    assert lp.distillation(df).first().kd_loss == 0.0


def test_kto_batch_without_one_class(spark):
    df = spark.createDataFrame([(0, 0, 1, 1.0, 0.0), (0, 0, -1, 2.0, 0.0)], "batch int, worker int, label int, policy double, reference double")
    row = pf.kto_uneven(df, 0.1).first()
    assert row.kl == 2.0 and abs(row.loss - (1 - 1 / (1 + math.exp(0.1)))) < 1e-12


def test_kto_batch_without_mismatched_pairs_stays(spark):
    rows = [(0, 0, 1, 1.0, 0.0), (0, 0, -1, 2.0, 0.0), (1, 0, 1, 1.0, 0.0), (1, 0, 0, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "batch int, worker int, label int, policy double, reference double")
    got = {r.batch: r for r in pf.kto_uneven(df, 0.1).collect()}
    assert got.keys() == {0, 1} and got[1].loss is None and got[1].kl is None
    assert abs(got[1].chosen_reward - 0.1) < 1e-12 and abs(got[1].rejected_reward - 0.3) < 1e-12 and got[0].rejected_reward is None


@pytest.mark.parametrize("block", [4096, 3])
def test_next_label_is_one_rule_for_all_sizes(spark, monkeypatch, block):
    monkeypatch.setattr(lp, "BLOCK", block)
    rows = [("a", i, 10 + i) for i in range(8)] + [("a", 3, 5), ("a", 10, 1), (None, 0, 7), (None, 1, 8), ("b", 2, 1), ("b", 3, 4), ("b", 3, 2)]
    df = spark.createDataFrame(rows, "seq_id string, pos int, label int")
    labels = {}
    for seq, pos, label in rows:
        labels[seq, pos] = min(label, labels.get((seq, pos), label))
    got = sorted((tuple(r) for r in lp.next_labels(df).select("seq_id", "pos", "label", "next_label").collect()), key=repr)
    assert got == sorted(((s, p, n, labels.get((s, p + 1))) for s, p, n in rows), key=repr)


def test_router_forms(spark):
    df = spark.createDataFrame([([3.0, 2.0, 1.0],), ([3.0, 2.0, 1.0],)], "logits array<double>")
    assert lp.router_balance(df, 3, 2).first().balance == 2.0
    p = np.exp([3, 2, 1]) / np.exp([3, 2, 1]).sum()
    assert abs(lp.router_balance(df, 3, 2, standard=True).first().balance - 3 * (p[0] + p[1])) < 1e-12


@pytest.mark.parametrize("decay,steps", [(0.95, 9000), (0.5, 900), (0.999, 500)])
def test_ema_over_many_blocks(spark, decay, steps):
    rng = np.random.default_rng(2)
    x = rng.normal(size=steps) * 10
    rows = [("long", i, float(v)) for i, v in enumerate(x)] + [("short", 5, 1.0), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "run string, step int, x double").repartition(6)
    got = {(r.run, r.step): r.ema for r in mn.ema(df, "x", step="step", by=["run"], decay=decay).collect()}
    mean = 0.0
    for i, v in enumerate(x):
        mean = mean * decay + (1 - decay) * v
        assert abs(got["long", i] - mean) < 1e-9
    assert abs(got["short", 5] - (1 - decay)) < 1e-12 and abs(got[None, 1] - 2 * (1 - decay)) < 1e-12


def test_best_of_n_ties_and_nan(spark):
    nan = float("nan")
    rows = [(0, "a", "x", 1.0), (1, "a", "y", 1.0), (2, "a", "z", nan), (3, "b", "p", nan), (4, "b", "q", 5.0), (5, "c", "s", -1.0)]
    df = spark.createDataFrame(rows, "pos bigint, input string, output string, reward double")
    got = {r.input: (r.output, r.first_pos) for r in rw.best_of_n(df).collect()}
    assert got == {"a": ("x", 0), "b": ("p", 3), "c": ("s", 5)}


@pytest.mark.parametrize("x", [0.125, 2.675, 1.005, -0.375, 1234567.891, 0.0, 99.995])
def test_reward_text_is_exact(spark, x):
    assert spark.createDataFrame([(x,)], "x double").select(rw.reward_text(F.col("x")).alias("t")).first().t == f"{x:.2f}"


def test_reward_condition_order_and_errors(spark):
    df = spark.createDataFrame([("say {reward}", 1.0)], "input string, reward double")
    assert rw.condition_on_reward(df).first().input == "say {reward} <rm_score>: 1.00 "
    with pytest.raises(ValueError):
        rw.condition_on_reward(df, "no slots")
    with pytest.raises(ValueError):
        rw.get_processor("xx")


def curve(values, low, high, factor, points):
    """The sum of the kernels of all values at every grid point."""
    h = factor * values.std(ddof=1)
    grid = np.linspace(low, high, points)
    return np.array([np.exp(-(((x - values) / h) ** 2) / 2).sum() for x in grid]) / (len(values) * h * math.sqrt(2 * math.pi))


@pytest.mark.parametrize("factor", [0.3, 0.01])
def test_density_equals_the_sum_of_all_kernels(spark, factor):
    df = spark.range(400).select(F.lit(1).alias("step"), F.sin("id").alias("v"))
    got = {r.point: r.density for r in ds.density(df, "v", factor=factor, points=50).collect()}
    v = np.sin(np.arange(400))
    want = curve(v, v.min(), v.max(), factor, 50)
    assert sorted(got) == list(range(50)) and all(abs(got[i] - want[i]) < 1e-7 * want.max() for i in range(50))


def test_density_with_an_outlier_and_another_step(spark):
    """A value far off stretches the range of all steps; the curve keeps its own cells."""
    v = np.random.default_rng(2).standard_normal(500)
    rows = [(1, float(x)) for x in v] + [(2, 1e5), (2, 1e5 + 1), (3, 7.0), (3, 7.0), (4, 1.0)]
    df = spark.createDataFrame(rows, "step int, v double")
    points = 1_000_001  # grid points a tenth apart
    drawn = ds.density(df, "v", factor=0.5, points=points, members=F.col("step") != 2)
    assert drawn.select("step").distinct().collect() == [(1,)]  # equal values and single ones have no curve
    near = drawn.filter("x < 5").collect()
    low, high, h = float(v.min()), 1e5 + 1, 0.5 * v.std(ddof=1)
    for r in near:
        at = low + (high - low) / (points - 1) * r.point
        want = np.exp(-(((at - v) / h) ** 2) / 2).sum() / (500 * h * math.sqrt(2 * math.pi))
        assert abs(r.density - want) < 1e-7
    assert max(r.density for r in near) > 0.3


def test_density_does_not_grow_with_the_rows(spark):
    """Cells, not rows, meet the grid."""
    df = spark.range(3000).select(F.lit(1).alias("step"), (F.col("id") % 10).cast("double").alias("v"))
    v = np.arange(3000) % 10.0
    want = curve(v, 0, 9, 0.2, 20)
    got = ds.density(df, "v", factor=0.2, points=20)
    assert np.allclose([r.density for r in got.orderBy("point").collect()], want, rtol=1e-9)


@pytest.mark.parametrize("n", [1, 300, 60_000])
def test_sketch_histogram(spark, n):
    """Exact while a sketch holds all values; beyond, off by less than the stated error."""
    df = spark.range(n).select((F.col("id") % 3).alias("step"), F.when(F.col("id") % 11 > 0, F.sin("id") * 7).alias("v"))
    df = df.unionByName(spark.createDataFrame([(1, float("nan"))], "step long, v double"))
    sketches = cut_lineage(ds.value_sketches(df, "v", by=["step"], k=400))
    got = {(r.step, r.bin): r.n for r in ds.sketch_histogram(sketches, 16, by=["step"]).collect()}
    exact = {(r.step, r.bin): r.n for r in ds.histogram(df.filter(~F.isnan("v") & F.col("v").isNotNull()), "v", 16).collect()}
    if n <= 300:
        assert got == exact
    sums = {s: sum(c for (t, _), c in exact.items() if t == s) for s, _ in exact}
    assert {s: sum(c for (t, _), c in got.items() if t == s) for s, _ in got} == sums
    error = 2 * 2.45 / 400 ** 0.943
    assert all(abs(got.get(k, 0) - exact.get(k, 0)) <= error * sums[k[0]] for k in got.keys() | exact.keys())
    merged = sketches.agg(F.kll_merge_agg_double("sketch").alias("s"), F.sum("n").alias("n")).first()
    assert (merged["n"] or 0) == sum(sums.values())


def test_sketch_of_equal_values(spark):
    df = spark.createDataFrame([(1, 2.0)] * 5, "step int, v double")
    assert ds.sketch_histogram(cut_lineage(ds.value_sketches(df, "v", by=["step"])), 4, by=["step"]).collect() == [(1, 1, 5)]


def test_snapshot_average_is_the_chain(spark):
    rng = np.random.default_rng(0)
    snaps = {step: {i: float(rng.standard_normal()) for i in range(20) if step >= 10 * (1 + i % 3)} for step in range(10, 110, 10)}
    rows = spark.createDataFrame([(s, i, x) for s, d in snaps.items() for i, x in d.items()], "step int, example_id long, logit double")
    for every in (10, 20):
        chain = None
        for step in sorted(s for s in snaps if s % every == 0):
            now = rows.filter(F.col("step") == step).select("example_id", "logit")
            chain = now if chain is None else cut_lineage(mn.snapshot_ema(chain, now, beta=0.7))
        want = {r.example_id: r.logit for r in chain.collect()}
        got = {r.example_id: r.logit for r in mn.snapshot_average(rows, beta=0.7, every=every).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert mn.snapshot_average(rows.limit(0)).count() == 0
    with pytest.raises(Exception, match="missing from a snapshot"):
        mn.snapshot_average(rows.filter("not (step = 50 and example_id = 0)")).collect()


def test_softmax_in_one_pass(spark):
    from tunedata.operators import weights as wt

    for values in ([0.1, 0.2, -3.0], [1000.0, 999.0, 699.5, 400.0, -5000.0], [-1e6, -1e6 + 1], [299.9999, 300.0, 300.0001], [5.0]):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "example_id long, logit double").repartition(3)
        z = np.array(values)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        got = {r.example_id: r.weight for r in wt.to_weights(df).collect()}
        assert np.allclose([got[i] for i in range(len(z))], len(z) * p, rtol=1e-12)
        assert abs(wt.entropy(df).first().neg_entropy - (p[p > 0] * np.log(p[p > 0])).sum()) < 1e-10


def test_mean_pooling_merges_one_vector_a_task(spark):
    from tunedata.operators import weights as wt

    rng = np.random.default_rng(4)
    rows = [(k, pos, [float(x) for x in rng.standard_normal(5)] if pos != 3 else None, 6) for k in range(4) for pos in range(9)]
    df = spark.createDataFrame(rows, "seq long, pos int, v array<float>, last int").repartition(7)
    pooled = wt.pool(df, "mean", key="seq", pos="pos", vector="v", last="last")
    for r in pooled.collect():
        want = np.mean([v for k, pos, v, last in rows if k == r.seq and pos <= last and v is not None], axis=0)
        assert np.allclose(r.pooled, want, atol=1e-6)
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Python" not in plan


def test_gather_and_reduce(spark):
    parts = [spark.createDataFrame([(1, "loss", float(i))], "step int, metric string, value double") for i in (1, 2, 6)]
    rows = mn.gather(*parts)
    assert {op: mn.reduce_metrics(rows, op).first().value for op in ("mean", "max", "sum")} == {"mean": 3.0, "max": 6.0, "sum": 9.0}
    with pytest.raises(ValueError):
        mn.reduce_metrics(rows, "median")
