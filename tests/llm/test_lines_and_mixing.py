import random
from collections import defaultdict

import brute
import pytest

from tunedata.llm import lines, mixing


def test_lines_against_brute_force(spark, make_docs):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(9)] + ["", "  "]
    rows = [(rng.choice([None, *range(50)]), "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for _ in range(80)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "a\na\na\na\na"), (64, "only one"), (65, "only one"), (65, "only one"), (66, "x\r\ny\r\nz")]
    docs = make_docs(rows)
    want, out = brute.dedup_lines(rows), lines.dedup_lines(docs)
    assert out.columns == docs.columns + ["n_lines", "n_removed"]
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r["text"])
    expected = defaultdict(list)
    for i, t in rows:
        expected[i].append(want[i, t] if t is not None else None)
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in expected.items()}
    assert lines.dedup_lines(make_docs([])).count() == 0


def test_long_repeated_text(make_docs):
    text = "\n".join(f"line {i}" for i in range(30_000))
    out = {r["doc_id"]: r for r in lines.dedup_lines(make_docs([(1, text), (2, "own start\n" + text + "\nown end")])).collect()}
    assert out[1]["text"] == text and out[2]["text"] == "own start\nown end" and out[2]["n_removed"] == 30_000


def mixed(docs, **options):
    located, parts = mixing.mix(docs, **options)
    return located, parts, sorted(map(tuple, mixing.taken_words(located, parts).collect()), key=repr)


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix(spark, make_docs, block):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 700])), rng.choice([None, "a", "a", "a", "a", "B", "é", "z"])) for i in range(150)]
    rows += [(None, None, "a"), (3, "same row", "a"), (3, "same row", "a"), (None, "x y", "z"), (900, "w " * 3000, "a"), (901, "", "empty")]
    located, parts, taken = mixed(make_docs(rows), block_words=block)
    assert len(taken) == len(rows) and taken == mixed(make_docs(list(reversed(rows))), block_words=block)[2]
    totals = defaultdict(int)
    for _, t, s in rows:
        totals[s] += len((t or "").split())
    target, sums = brute.targets(totals), defaultdict(int)
    for _, source, size, source_size, wanted, words in taken:
        assert 0 <= words <= 2 * size and source_size == totals[source] and abs(wanted - target[source]) < 1e-6
        sums[source] += words
    assert all(abs(sums[s] - target[s]) <= 1 for s in totals)
    # Slots are used once, each by one block of one source, in order, and evenly over the mix.
    slots = parts.groupBy("slot").agg({"rank": "min", "block": "min", "n_words": "sum"}).orderBy("slot").collect()
    assert len({r["slot"] for r in slots}) == parts.select("rank", "block").distinct().count()
    by = defaultdict(list)
    for r in slots:
        assert r["sum(n_words)"] <= block
        by[r["min(rank)"]].append(r["min(block)"])
    assert all(v == list(range(len(v))) for v in by.values())
    if block == 7:
        half = [r["min(rank)"] for r in slots if r["slot"] < max(s["slot"] for s in slots) / 2]
        assert all(abs(half.count(k) - len(v) / 2) <= 3 for k, v in by.items())


def test_mix_of_nothing(make_docs):
    assert mixed(make_docs([]))[2] == []
    assert mixed(make_docs([(1, None, "a"), (2, "", None)]))[2] == [(1, "a", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]


def test_schedule_in_chunks(spark, monkeypatch):
    sources = spark.createDataFrame([(0, 5000), (1, 1200), (2, 1)], "rank int, words long")
    want = sorted(map(tuple, mixing.slot_schedule(sources, 3).collect()))
    monkeypatch.setattr(mixing, "CHUNK_BITS", 4)
    assert sorted(map(tuple, mixing.slot_schedule(sources, 3).collect())) == want
