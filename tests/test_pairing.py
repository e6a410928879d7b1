import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tunedata.functions.permutation import permuted
from tunedata.operators import pairing as pr


@settings(max_examples=6, deadline=None)
@given(st.integers(1, 25), st.integers(1, 7))
def test_shards_are_equal_and_cover_all(spark, n, shards):
    got = pr.assign_shards(spark.range(n), "id", shards, seed=1).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(shards)]
    assert set(sizes) == {-(-n // shards)}
    assert {r.id for r in got} == set(range(n))
    dropped = pr.assign_shards(spark.range(n), "id", shards, seed=1, drop_last=True).collect()
    assert len(dropped) == n // shards * shards and len({r.id for r in dropped}) == len(dropped)


def zipped(n_a, n_b, epochs):
    """The loader pair: the shorter one is an endless iterator that is never reset."""
    out, used = [], 0
    for e in range(epochs):
        for s in range(max(n_a, n_b)):
            if n_a < n_b:
                out.append((e, s, (used + s) % n_a, s))
            else:
                out.append((e, s, s, (used + s) % n_b))
        used += max(n_a, n_b) + (1 if n_a < n_b else 0)
    return out


@pytest.mark.parametrize("n_a,n_b", [(3, 7), (7, 3), (4, 4), (1, 5)])
def test_cyclic_zip(spark, n_a, n_b):
    a, b = (spark.range(2 * n).withColumn("batch", F.floor(F.col("id") / 2)) for n in (n_a, n_b))
    for epoch in range(3):
        rows = pr.cyclic_zip(a, b, epoch=epoch).collect()
        got = {(r.step, r.side): r.batch for r in rows}
        assert len(rows) == 4 * max(n_a, n_b)
        for e, s, want_a, want_b in zipped(n_a, n_b, 3):
            if e == epoch:
                assert (got[s, "a"], got[s, "b"]) == (want_a, want_b)


def test_balanced_interleave(spark):
    df = spark.range(30).withColumn("label", (F.col("id") < 11).cast("int"))
    got = sorted(pr.balanced_interleave(df, "id", "label", seed=1).collect(), key=lambda r: r.slot)
    assert [r.label for r in got] == [1, 0] * 11
    with pytest.raises(Exception, match="differ in size"):
        pr.balanced_interleave(df, "id", "label", seed=1, strict=True).collect()


def test_mismatch_wraps_within_batch(spark):
    df = spark.range(5).select(
        F.col("id").alias("pos"), F.floor(F.col("id") / 3).alias("batch"), F.concat(F.lit("p"), "id").alias("prompt"),
        F.concat(F.lit("r"), "id").alias("response"), F.lit(1).alias("label"))
    got = {(r.prompt, r.response) for r in pr.mismatch_pairs(df).collect() if r.label == -1}
    assert got == {("p0", "r1"), ("p1", "r2"), ("p2", "r0"), ("p3", "r4"), ("p4", "r3")}
    assert pr.mismatch_pairs(df, vanilla=True).count() == 5


def test_pad_sides(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [5])], "batch int, t array<int>")
    left = sorted(r.t for r in pr.pad_batch(df, "t", side="left", value=9).collect())
    right = sorted(r.t for r in pr.pad_batch(df, "t", side="right", value=9).collect())
    assert left == [[1, 2, 3], [5], [9, 9, 4]] and right == [[1, 2, 3], [4, 9, 9], [5]]
    with pytest.raises(ValueError):
        pr.pad_batch(df, "t", side="middle")


def test_sides_return_to_pairs(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "pair_id int, c double, r double")
    row = pr.repair_sides(pr.stack_sides(df, "c", "r", out="logp"), "pair_id", "logp").first()
    assert (row.logp_chosen, row.logp_rejected) == (2.0, 3.0)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 256, 257, 1000])
def test_permutation_is_a_bijection_and_differs_by_seed(spark, n):
    df = spark.range(n).select("id", *[permuted(F.col("id"), n, seed).alias(f"p{seed}") for seed in (1, 2)])
    rows = df.collect()
    for seed in (1, 2):
        assert sorted(r[f"p{seed}"] for r in rows) == list(range(n))
    if n > 10:
        assert [r.p1 for r in rows] != [r.p2 for r in rows] and [r.p1 for r in rows] != list(range(n))


def test_permutation_looks_random(spark):
    """Neighbours land anywhere, and any place is taken by any number about equally often."""
    n = 2000
    rows = spark.range(n).select(permuted(F.col("id"), n, 5).alias("p")).collect()
    gaps = [abs(a.p - b.p) for a, b in zip(rows, rows[1:])]
    assert 0.28 * n < sum(gaps) / len(gaps) < 0.39 * n
    first = spark.range(400).select(permuted(F.lit(3), 10, F.col("id")).alias("p")).groupBy("p").count().collect()
    assert len(first) == 10 and max(r["count"] for r in first) < 75


@pytest.mark.parametrize("drop_last", [False, True])
def test_shards_of_all_epochs(spark, drop_last):
    ids = [f"x{i}" for i in range(23)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    rows = pr.assign_shards_over(df, "id", 5, seed=3, epochs=4, drop_last=drop_last).collect()
    for epoch in range(4):
        here = [r for r in rows if r.epoch == epoch]
        places = sorted((r.shard_pos, r.shard) for r in here)
        size = 4 if drop_last else 5
        assert places == [(p, s) for p in range(size) for s in range(5)]
        assert {r.id for r in here} <= set(ids) and (drop_last or {r.id for r in here} == set(ids))
    orders = {tuple(r.id for r in sorted((r for r in rows if r.epoch == e), key=lambda r: (r.shard_pos, r.shard))) for e in range(4)}
    assert len(orders) == 4


@pytest.mark.parametrize("n_a,n_b", [(25, 70), (70, 25), (40, 40), (3, 100)])
def test_paired_epochs_follow_two_loaders(spark, n_a, n_b):
    """Batches drawn as two loaders would, the shorter one begun again whenever it ends."""
    a = spark.range(n_a).withColumnRenamed("id", "i")
    b = spark.range(1000, 1000 + n_b).withColumnRenamed("id", "i")
    rows = pr.zip_epochs(a, b, "i", 10, seed=9, epochs=3).collect()
    got = {}
    for r in rows:
        got.setdefault((r.epoch, r.side, r.step), set()).add(r.i)

    def batches(first, n, epoch):
        order = spark.range(n).select("id", permuted(F.col("id"), n, 9 + epoch).alias("p")).orderBy("p").collect()
        ids = [first + r.id for r in order]
        return [set(ids[i:i + 10]) for i in range(0, n, 10)]

    sizes = {"a": (0, n_a), "b": (1000, n_b)}
    short = "a" if -(-n_a // 10) < -(-n_b // 10) else "b"
    longer = "b" if short == "a" else "a"
    want, left = {}, batches(*sizes[short], 0)
    for epoch in range(3):
        for step, batch in enumerate(batches(*sizes[longer], epoch)):
            if not left:
                left = batches(*sizes[short], epoch)
            want[epoch, longer, step] = batch
            want[epoch, short, step] = left.pop(0)
        if short == "a":  # the first loader is asked before the second one ends the epoch
            if not left:
                left = batches(*sizes[short], epoch)
            left.pop(0)
    assert got == want
