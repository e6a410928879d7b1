import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tunedata.llm import neardup, sketch
from tunedata.llm.components import components
from tunedata.llm.queries import QUERIES


def result(df):
    return sorted(((r["key"]["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def wanted(rows, k=5, percent=80):
    return sorted(((i, n, c, i == c) for (i, _), (n, c) in zip(rows, brute.near_duplicates(rows, k, percent))), key=repr)


def edited(base, n, rng):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op10_near_duplicates"](spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == wanted(rows, 4)


def test_family_of_near_copies(spark, make_docs, monkeypatch):
    """Copies with more and fewer edits, so that many pairs lie about the limit; small blocks, so that groups are split."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, edited(base, rng.choice([0, 1, 2, 4, 6, 9]), rng)) for i in range(120)]
    rows += [(200 + i, " ".join(f"u{rng.randrange(9000)}" for _ in range(60))) for i in range(30)]
    assert result(neardup.near_duplicates(make_docs(rows))) == wanted(rows)


def test_a_large_group_is_read_a_bounded_number_of_times(spark, make_docs, monkeypatch):
    """One group of hundreds of near copies in small blocks, some of which reach it by others only, and strangers in it."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 20)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(i, edited(base, rng.choice([0, 1, 1, 2]), rng)) for i in range(400)]
    chain = list(base)
    for i in range(25):  # each is near the one before it, the last ones far from the first
        chain[i * 6:i * 6 + 2] = [f"c{i}", f"d{i}"]
        rows.append((1000 + i, " ".join(chain)))
    compared = []
    cross = neardup._crosslinker
    assert result(neardup.near_duplicates(make_docs(rows))) == wanted(rows)
    groups = spark.createDataFrame([(0, i) for i in range(300)], "rep long, member long")
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows[:300])], "member long, text string")
    monkeypatch.setattr(neardup, "_crosslinker", lambda *a: compared.append("cross") or cross(*a))
    links = neardup.exact_links(groups, texts, 5, 60).collect()
    assert len(links) == 299 and not compared  # all near the representative: a star, and nothing is compared again


def test_sets_that_share_a_digest(spark, make_docs):
    """All sets of a word count share the first digest here."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, edited(base, i % 4, rng) if i % 3 else " ".join(f"u{rng.randrange(9000)}" for _ in range(40))) for i in range(40)]
    rows += [(100 + i, text) for i, text in rows[:10]]
    marked = neardup.sketched(make_docs(rows), "doc_id", "text", 5).withColumn("class", F.when(F.col("size") > 0, F.col("size") % 3))
    apart, classes = neardup.distinct_sets(marked)
    sets = {frozenset(brute.shingle_set(t, 5)) for _, t in rows}
    assert classes.count() == apart.select("class").distinct().count() == len(sets)
    by_class = {}
    for r in apart.collect():
        by_class.setdefault(r["class"], set()).add(frozenset(brute.shingle_set(dict(rows)[r["key"]["id"]], 5)))
    assert all(len(s) == 1 for s in by_class.values())


def test_very_long_text(spark, make_docs):
    long = " ".join(f"w{i % 7919}" for i in range(200_000))
    rows = [(1, long), (2, long + " more"), (3, "short one of some words")]
    assert result(neardup.near_duplicates(make_docs(rows))) == wanted(rows)


def test_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE Two"), (6, "one two"), (6, "one two"), (None, "one two"),
            (None, "of its own here"), (None, "of its own here"), (7, "a b c d e f g h"), (8, "É" * 3), (9, "é" * 3), (2, "")]
    assert result(neardup.near_duplicates(make_docs(rows))) == wanted(rows)
    assert neardup.near_duplicates(make_docs([])).count() == 0
    assert neardup.near_duplicates(make_docs([(1, None)])).count() == 1


@pytest.mark.parametrize("n", [1, 2, 5, 40, 3000])
def test_sketch_agrees_like_jaccard(n):
    rng = np.random.default_rng(n)
    hits, t = [], 128
    for _ in range(40):
        both, one, two = (rng.integers(0, 2**63, size).astype(np.uint64) for size in (4 * n, n, n))
        a, b = sketch.sketch(np.concatenate([both, one]), t), sketch.sketch(np.concatenate([both, two]), t)
        hits.append((a == b).mean())
    assert abs(np.mean(hits) - 4 / 6) < 0.05


def test_common():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    want = np.array([[len(set(a) & set(b)) for b in sets] for a in sets])
    got = sketch.common(sets)
    assert (got - np.diag(np.diag(got)) == want - np.diag(np.diag(want))).all()
    assert (sketch.common(sets[:10], sets[10:]) == want[:10, 10:]).all()


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    tree = {x: x for link in links for x in link}

    def root(x):
        return x if tree[x] == x else root(tree[x])

    for a, b in links:
        tree[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in linked)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_large_ids_beside_null(spark, make_docs):
    low, text = 2 ** 60 + 1, " ".join(f"w{i}" for i in range(60))
    docs = make_docs([(low, text), (low + 2, text + " more"), (None, "quite another text of some words here"), (low + 4, "alone in this table of texts")]).coalesce(1)
    got = {r["key"]["id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {low: (low, True), low + 2: (low, False), None: (None, True), low + 4: (low + 4, True)}
