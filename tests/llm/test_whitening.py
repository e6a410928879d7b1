import numpy as np
import pytest
from pyspark.sql import functions as F

from tunedata.llm import whitening
from tunedata.llm.queries import QUERIES


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("name,v", [
    ("one", np.array([[3.0]])), ("small", symmetric(np.linspace(1, 2, 30))), ("just more than the subspace", symmetric(np.linspace(1, 9, 45))),
    ("close", symmetric(1 + np.arange(90) / 1000)), ("falling", symmetric(0.9 ** np.arange(120))), ("equal", 5 * np.eye(64)),
    ("groups", symmetric(np.repeat([9.0, 4.0, 1.0], 50))), ("rank 3", symmetric([9.0, 4.0, 1.0] + [0.0] * 61)), ("large", symmetric(np.geomspace(1, 1e9, 100))),
    ("zero", np.zeros((10, 10)))])
def test_jacobi_davidson(name, v):
    v = (v + v.T) / 2
    calls = []
    values, vectors, passes = whitening.jacobi_davidson(lambda u: calls.append(u.shape[1]) or v @ u, len(v), 32)
    want = np.linalg.eigvalsh(v)[::-1][:32]
    top = max(abs(want).max(), 1e-300)
    assert passes == len(calls) and values.shape == want.shape
    assert np.abs(values - want).max() <= 1e-13 * top * len(v)
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-12 * top


def test_noisy_products_end():
    """Products that are only good to some digits end at what they allow, or with an error."""
    rng = np.random.default_rng(1)
    v = symmetric(np.geomspace(1, 100, 100))
    values, _, _ = whitening.jacobi_davidson(lambda u: (v @ u) * (1 + 1e-14 * rng.standard_normal(u.shape)), 100, 8)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:8]).max() < 1e-9
    with pytest.raises(ArithmeticError):
        whitening.jacobi_davidson(lambda u: (v @ u) * (1 + 1e-3 * rng.standard_normal(u.shape)), 100, 8)


def model(rows, components=32, scale=64, offset=1_000_000):
    """NumPy: the same from the whole matrix, with whole numbers for what is exact."""
    x = np.array([[int(np.floor(float(c) * scale)) + offset for c in row] for row in rows], dtype=object)
    n, s = len(x), x.sum(0)
    apart = n * x - s
    c = apart.astype(float) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    real = e > len(v) * 2.0**-52 * np.trace(v)
    return n, [int(d) for d in (apart ** 2).sum(1)], c @ (u[:, real] / np.sqrt(e[real])), e[real] / np.trace(v)


def same_up_to_sign(got, want):
    signs = np.sign((got * want).sum(0))
    assert np.abs(got * signs - want).max() < 1e-6


def test_query_against_the_whole_matrix(spark, sf_dir):
    given = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, values, explained = model([r["embedding"] for r in given])
    rows = QUERIES["op11_whitening"](spark, sf_dir).orderBy("vec_id", "component").collect()
    k = len(explained)
    assert len(rows) == n * k and {r["n"] for r in rows} == {n} and [r["component"] for r in rows[:k]] == list(range(1, k + 1))
    assert [r["deviation"] for r in rows[::k]] == deviation and [r["vec_id"] for r in rows[::k]] == [r["vec_id"] for r in given]
    assert np.allclose([r["explained"] for r in rows[:k]], explained, rtol=1e-10)
    same_up_to_sign(np.array([r["whitened"] for r in rows]).reshape(n, k), values)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def frame(spark, vectors):
    rows = [(i, v, "w", 1.0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, whole string, row double").repartition(3)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = [list(map(float, v)) for v in rng.standard_normal((40, 6)) * [5, 4, 3, 2, 1, 0]]
    good += [good[0]] * 3 + [[1e4] * 6, [float(2**15)] + [0.0] * 5, [1.0, 2.0], []]
    bad = [None, [None] * 6, [nan] * 6, [inf] + [0.0] * 5, [1.0, None, 2.0, 3.0, 4.0, 5.0]]
    df = frame(spark, good + bad).withColumn("vec_id", F.when(F.col("vec_id") > 2, F.col("vec_id")))
    out = whitening.whiten(df, "embedding")
    assert out.columns == ["vec_id", "embedding", "whole", "row", "whitened"]
    rows = out.collect()
    filled = [v + [0.0] * (6 - len(v)) for v in good]
    order = [tuple(r["embedding"]) for r in rows]
    n, _, _, explained = model(filled)
    assert sorted(order) == sorted(map(tuple, good)) and {r["whitened"]["n"] for r in rows} == {n}
    at = [next(i for i, v in enumerate(good) if tuple(v) == o) for o in order]
    n, deviation, values, explained = model([filled[i] for i in at])
    assert np.allclose(rows[0]["whitened"]["explained"], explained, rtol=1e-9)
    k = min(len(explained), 2)
    same_up_to_sign(np.array([r["whitened"]["values"] for r in rows])[:, :k], values[:, :k])


def test_deviation_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="OverflowError"):
        whitening.whiten(frame(spark, [[float(2**40)], [0.0], [1.0]]), "embedding").collect()


def test_deviation_is_exact(spark):
    vectors = [[float(2**20 + i), float(-i)] for i in range(50)]
    rows = whitening.whiten(frame(spark, vectors), "embedding").orderBy("vec_id").collect()
    assert [r["whitened"]["deviation"] for r in rows] == model(vectors)[1]


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [[]], [[], []]])
def test_without_spread(spark, vectors):
    rows = whitening.whiten(frame(spark, vectors).limit(len(vectors)), "embedding").collect()
    assert len(rows) == len([v for v in vectors if v is not None])
    for r in rows:
        assert r["whitened"]["values"] == r["whitened"]["explained"] == [] and r["whitened"]["deviation"] == 0


def test_tasks_are_added_in_any_number(spark):
    vectors = [[float(i % 7), float(i % 5), float(i % 3)] for i in range(300)]
    results = []
    for parts in (1, 7, 90):
        whole = whitening.whole_vectors(frame(spark, vectors).repartition(parts), "embedding").select("whole")
        fitted = whitening.fit(whole, 3)
        results.append((fitted.moments, np.round(fitted.values, 6).tolist()))
    assert results[0] == results[1] == results[2]
