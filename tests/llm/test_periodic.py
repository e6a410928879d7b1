import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tunedata.llm import periodic
from tunedata.llm.queries import QUERIES


def runs_of(words, exponent=4, least=6):
    """Every maximal stretch of its smallest period, by trying all periods."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            stretch = words[start:end]
            if end - start >= max(least, exponent * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((start, end - start, q))
    return sorted(out)


def described(doc_id, text):
    """A row of the query, from the contract."""
    words = text.encode().split() if text else []
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_of(words)
    best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if runs else (None,) * 3
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha256(listed).hexdigest(), sha256(kept).hexdigest())


words = st.lists(st.integers(0, 2), max_size=70)


@settings(max_examples=300, deadline=None)
@given(words, st.lists(st.integers(1, 9), max_size=40), st.integers(3, 4))
def test_any_way_of_appending(given_words, cuts, exponent):
    catcher, at = periodic.SquareCatcher(), 0
    for cut in [*cuts, len(given_words)]:
        catcher.append(np.array(given_words[at:at + cut], dtype=np.int64))
        at += cut
    catcher.append(np.array(given_words[at:], dtype=np.int64))
    assert catcher.runs(exponent) == runs_of(given_words, exponent)


def test_planted_periods():
    rng = random.Random(4)
    for _ in range(150):
        w = [rng.randrange(40) for _ in range(rng.randrange(1, 400))]
        a, p = rng.randrange(len(w)), rng.randrange(1, 60)
        w[a:] = [w[a + (i - a) % p] for i in range(a, len(w))] if a + p < len(w) else w[a:]
        texts = [np.array(w, dtype=np.int64), np.array([], dtype=np.int64), np.array(w[::-1], dtype=np.int64), np.array([3] * 50)]
        assert periodic.runs_of(texts) == [runs_of(list(map(int, t))) for t in texts]


def test_long_and_regular_texts_end():
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    assert periodic.runs_of([np.array(b)]) == [[]]  # no stretch of a Fibonacci word has four periods
    assert periodic.runs_of([np.zeros(1_000_000, np.int64)]) == [[(0, 1_000_000, 1)]]
    unit = np.random.default_rng(0).integers(0, 1000, 99_991)
    assert periodic.runs_of([np.tile(unit, 5)]) == [[(0, 5 * 99_991, 99_991)]]
    with pytest.raises(ValueError):
        periodic.SquareCatcher().runs(2)


def test_query_against_all_periods(spark, sf_dir):
    """Documents of any length are read; the slow model tries those of up to 1,500 words."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    short = [r for r in rows if len((r["text"] or "").split()) <= 1500]
    assert len(short) > len(rows) / 2 and any(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in short)
    for r in short:
        assert got[r["doc_id"]] == described(r["doc_id"], r["text"])


def test_cases(spark):
    long = "x " * 400_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a"), (4, "b c b c b c b c d"), (4, "b c b c b c b c d"), (5, long),
            (6, "a\u00a0a a a a a a a"), (7, "p q " * 2 + "z " * 5), (8, "z z z z z z y y y y y y"), (9, "é é é é é é")]
    df = spark.createDataFrame([(*r, "old", 1, 2) for r in rows], "doc_id long, text string, periodic string, start int, runs int")
    found = periodic.periodic_runs(df)
    assert found.columns == ["doc_id", "text", "periodic", "start", "runs"]
    got = found.select("doc_id", "periodic.n_runs", "periodic.start", "periodic.period", "periodic.collapsed", "periodic.exponent_milli").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, None, None, "", None), (2, 0, None, None, "", None), (3, 0, None, None, "", None), (None, 1, 0, 1, "a", 6000),
        (4, 1, 0, 2, "b c d", 4000), (4, 1, 0, 2, "b c d", 4000), (5, 1, 0, 1, "x", 400_000_000), (6, 1, 1, 1, "a\u00a0a a", 6000),
        (7, 0, None, None, "p q p q z z z z z", None), (8, 2, 0, 1, "z y", 6000), (9, 1, 0, 1, "é", 6000)]
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    tail = periodic.periodic_runs(spark.createDataFrame([(i, "a b c d e f g h i j k l") for i in range(60)], "doc_id long, text string"),
                                  tail=periodic.tail_number("doc_id"))
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [tuple(r) for r in tail.select("doc_id", *[F.col(f"periodic.{n}") for n in names]).collect()] == [
        described(i, "a b c d e f g h i j k l") for i in range(60)]
