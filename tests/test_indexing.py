import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tunedata.operators import indexing as ix


def brute(rows, by):
    """rows: (group, key, tie, value) -> {(group, key, tie): (position, running sum)}"""
    out, state = {}, {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        g = row[0] if by else None
        n, total = state.get(g, (0, 0))
        out[row[:3]] = (n, total + row[3])
        state[g] = (n + 1, total + row[3])
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, k bigint, t bigint, x bigint").repartition(5)


def check(spark, rows, by, ranges=16):
    df = frame(spark, rows)
    sums = {"n": F.lit(1).cast("bigint"), "s": F.col("x")}
    got = ix.running_sums(df, "k", sums, by=["g"] if by else [], tie=["t"], ranges=ranges).collect()
    assert len(got) == len(rows)
    assert {(r.g, r.k, r.t): (r.n - 1, r.s) for r in got} == brute(rows, by)


@pytest.mark.parametrize("hot", [None, 0, 100])
@pytest.mark.parametrize("by", [False, True])
@pytest.mark.parametrize("ranges", [None, 1, 5, 40])
def test_running_sums_with_heavy_keys_and_groups(spark, by, ranges, hot, monkeypatch):
    monkeypatch.setattr(ix, "RANGE_ROWS", ix.RANGE_ROWS if hot is None else hot)
    rng = random.Random(1)
    rows = []
    for i in range(900):
        group = None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 40}"
        key = 7 if i % 3 == 1 else rng.randrange(-500, 500)
        rows.append((group, key, i, rng.randrange(10)))
    check(spark, rows, by, ranges)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 5)), min_size=1, max_size=60), st.booleans())
def test_running_sums_property(spark, pairs, by):
    rows = [(f"g{g % 3}", g, i, x) for i, (g, x) in enumerate(pairs)]
    check(spark, rows, by, ranges=8)


def test_dense_ids_double_key(spark):
    df = spark.range(500).withColumn("k", (F.col("id") % 37) / 10.0 - 1)
    got = {r.id: r.pos for r in ix.rank_rows(df, "k", tie=["id"]).collect()}
    want = sorted(range(500), key=lambda i: ((i % 37), i))
    assert [got[i] for i in want] == list(range(500))


@pytest.mark.parametrize("kind", ["string", "timestamp", "date", "decimal(12,2)", "binary"])
def test_keys_of_other_types(spark, kind, monkeypatch):
    monkeypatch.setattr(ix, "RANGE_ROWS", 40)
    monkeypatch.setattr(ix, "RANGES", 12)
    text = F.concat(F.when(F.col("id") % 2 == 0, "a common start ").otherwise("É"), F.lpad(F.col("id").cast("string"), 4, "0"))
    key = {"string": text, "binary": F.encode(text, "utf-8")}.get(kind, F.timestamp_seconds(F.col("id") * 90_000) if kind in ("date", "timestamp") else F.col("id") / 4)
    df = spark.range(400).select("id", key.cast(kind).alias("k"))
    got = [r.pos for r in ix.rank_rows(df, "k", tie=["id"]).orderBy("k", "id").collect()]
    assert got == list(range(400))
    with pytest.raises(TypeError):
        ix.rank_rows(spark.range(3).select(F.array("id").alias("k")), "k")


def test_heavy_key_is_cut_by_any_tie(spark):
    df = spark.range(600).select(F.lit(5).alias("k"), F.format_string("%05d", "id").alias("t"))
    assert [r.pos for r in ix.rank_rows(df, "k", tie=["t"], ranges=8).orderBy("t").collect()] == list(range(600))


def test_shuffle_rank_is_reproducible(spark):
    df = spark.range(300)
    a = {r.id: r.pos for r in ix.shuffle_rank(df, "id", seed=1).collect()}
    b = {r.id: r.pos for r in ix.shuffle_rank(df.repartition(7), "id", seed=1).collect()}
    c = {r.id: r.pos for r in ix.shuffle_rank(df, "id", seed=2).collect()}
    assert a == b != c and sorted(a.values()) == list(range(300))


def test_callers_agree_whatever_the_ranges(spark, monkeypatch):
    """Blend, shards, averages and token losses give the same rows with one range and with many."""
    from tunedata.operators import blending, logprobs, monitoring, pairing

    runs = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("run"), F.col("id").alias("step"),
        F.sin("id").alias("x"))
    tokens = spark.range(300).select(
        (F.col("id") % 2).alias("seq_id"), F.floor(F.col("id") / 2).alias("pos"), (-F.col("id") / 7).alias("logp"),
        F.when(F.col("id") % 5 == 0, -100).otherwise(1).alias("label"))
    parts = [spark.range(200), spark.range(90)]

    def results():
        frames = [
            blending.blend(parts, [0.7, 0.3], order_col="id", seed=1).select("slot", "id", "source"),
            blending.blend_sweep(*parts, [0.1, 0.5], order_col="id").select("ratio", "slot", "id"),
            pairing.balanced_interleave(parts[0].withColumn("y", F.col("id") % 2), "id", "y", seed=1),
            monitoring.ema(runs, "x", step="step", by=["run"], decay=0.2).select("run", "step", F.round("ema", 9)),
            logprobs.sequence_loss(tokens).select("seq_id", F.round("loss", 9), "n_tokens"),
        ]
        return [sorted(map(tuple, f.collect()), key=repr) for f in frames]

    plain = results()
    monkeypatch.setattr(ix, "RANGE_ROWS", 10)
    assert results() == plain
    monkeypatch.setattr(ix, "RANGES", 45)
    assert results() == plain


def spread(spark, df, key, **how):
    """Rows of each range that ranking writes."""
    written = []
    keep = ix.cut_lineage
    ix.cut_lineage = lambda local: written.append(keep(local)) or written[-1]
    try:
        ranked = ix.rank_rows(df, key, **how)
    finally:
        ix.cut_lineage = keep
    number = F.col("_range") if "_range" in written[-1].columns else F.shiftright("_row", 33)
    return ranked, [r["count"] for r in written[-1].groupBy(number).count().collect()]


def test_texts_with_a_common_start_are_spread(spark):
    df = spark.range(20_000).select(F.concat(F.lit("doc-0000-0000-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("k"))
    ranked, sizes = spread(spark, df, "k", ranges=8)
    assert len(sizes) == 8 and max(sizes) < 4000
    assert ranked.filter(F.col("pos") != F.substring("k", 15, 9).cast("long")).count() == 0


def test_a_hot_group_and_a_hot_key_are_spread(spark, monkeypatch):
    monkeypatch.setattr(ix, "RANGE_ROWS", 5000)
    df = spark.range(20_000).select(F.when(F.col("id") % 20 > 0, 1).otherwise(F.col("id")).alias("g"), F.lit(7).alias("k"), "id")
    ranked, sizes = spread(spark, df, "k", by=["g"], tie=["id"], ranges=8)
    assert len(sizes) == 8 and max(sizes) < 4000
    hot = sorted((r.id, r.pos) for r in ranked.filter("g = 1").collect())
    assert [pos for _, pos in hot] == list(range(len(hot)))


def test_one_shuffle_and_no_join_of_the_rows(spark):
    plan = ix.rank_rows(spark.range(1000), "id", ranges=4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastExchange") == 1
    rows = spark.range(1000).withColumn("g", F.col("id") % 7)
    plan = ix.rank_rows(rows, "id", by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_nulls_and_nan_as_groups(spark, monkeypatch):
    nan = float("nan")
    rows = [(g, i, 0.5) for g in (None, nan, 1.0, -1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "g double, k int, x double").repartition(6)
    sums = {"n": F.lit(1), "s": F.when(F.col("k") % 2 == 0, F.col("x"))}
    for hot, ranges in ((10**6, 4), (0, 1), (0, 7), (0, 50)):
        monkeypatch.setattr(ix, "RANGE_ROWS", hot)
        got = ix.running_sums(df, "k", sums, by=["g"], ranges=ranges).collect()
        assert len(got) == 120 and all(r.n == r.k + 1 and r.s == 0.5 * (r.k // 2 + 1) for r in got)


def test_rows_in_order_are_not_shuffled(spark):
    got = ix.running_sums(spark.range(0, 1000, 1, 9), "id", {"s": F.col("id")}, in_order=True)
    assert {r.id: r.s for r in got.collect()} == {i: i * (i + 1) // 2 for i in range(1000)}
    assert ix.rank_rows(spark.range(0), "id").count() == 0


def test_sums_do_not_lose_digits_of_other_groups(spark, monkeypatch):
    monkeypatch.setattr(ix, "RANGE_ROWS", 0)
    rows = [("a", i, 1e15) for i in range(50)] + [("b", i, 1e-3) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, k int, x double").coalesce(1)
    got = ix.running_sums(df, "k", {"s": F.col("x")}, by=["g"], ranges=1).filter("g = 'b'").collect()
    assert all(abs(r.s - 1e-3 * (r.k + 1)) < 1e-15 for r in got)
