import random

import brute
from pyspark.sql import functions as F

from tunedata.llm import decontam


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def flagged(docs, items):
    out = decontam.flag(docs, decontam.contamination(docs, items))
    return sorted(((r["doc_id"], r["text"], r["n_hit"], len(r["items"])) for r in out.collect()), key=repr)


def test_against_brute_force(spark, make_docs):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(12)] + ["Éa", "X1"]
    item_texts = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (1, 3, 9, 10, 11, 14, 30, 30)] + ["", None, "...", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w1 w2"]
    items = list(enumerate(item_texts)) + [(None, "null item here w1"), (5, "twice the same id")]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            source = (rng.choice(item_texts[3:8])).split()
            k = rng.randrange(len(source))
            words[len(words) // 2:len(words) // 2] = source[k:k + 16]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words).upper() if i % 3 else " ".join(words)))
    rows += [(100, None), (101, ""), (102, item_texts[6] * 20), (None, item_texts[6]), (None, item_texts[6]), (103, "null ITEM here: w1"), (0, "twice the same id")]
    docs = make_docs(rows)
    found = decontam.contamination(docs, bench(spark, items))
    got = {(r["key"]["id"], r["key"]["h1"]): (r["n_hit"], len(r["items"])) for r in found.collect()}
    keys = docs.select(decontam.row_key("doc_id", "text").alias("k"), "text").collect()
    for r in keys:
        _, hit, n, _ = brute.contamination(r["text"], items)
        assert got.get((r["k"]["id"], r["k"]["h1"]), (0, 0)) == (hit, n), r["text"]


def test_rows_and_columns_stay(spark, make_docs):
    docs = make_docs([(1, None), (2, "a b c"), (2, "a b c"), (None, None)])
    out = decontam.flag(docs, decontam.contamination(docs, bench(spark, [(1, "b")])))
    assert out.columns == docs.columns + ["n_hit", "items", "contaminated"]
    assert sorted(r["n_hit"] for r in out.collect()) == [0, 0, 1, 1]
    for rows, items in (([], [(1, "a")]), ([(1, "a")], []), ([(1, "a")], [(1, None)])):
        docs = make_docs(rows)
        assert decontam.flag(docs, decontam.contamination(docs, bench(spark, items))).filter("contaminated").count() == 0


def test_beyond_broadcast(spark, make_docs, monkeypatch):
    docs, items = make_docs([(i, f"x{i} the same ten words stand in all of these texts y{i}") for i in range(20)]), bench(spark, [(1, "the same ten words stand in all of these texts")])
    want = flagged(docs, items)
    assert {r[2] for r in want} == {10}
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert flagged(docs, items) == want


def test_very_long_text(spark, make_docs):
    """More than a megabyte, with a passage at its end and a common word throughout."""
    passage = " ".join(f"p{i}" for i in range(12))
    long = " ".join("the" if i % 3 else f"w{i % 9973}" for i in range(250_000))
    docs = make_docs([(1, f"{long} {passage}"), (2, long), (3, passage)])
    found = decontam.contamination(docs, bench(spark, [(7, passage), (8, "the the"), (9, "the w3 the")])).collect()
    items = {r["key"]["id"]: (r["n_hit"], r["items"]) for r in found}
    words_of = {i: brute.contamination(t, [(7, passage), (8, "the the"), (9, "the w3 the")]) for i, t in ((3, passage),)}
    assert items[3] == (12, ["7"]) and words_of[3][1] == 12
    the_the = sum(1 for i in range(250_000) if i % 3)
    around = {at for i in range(250_000) if not i % 3 and i % 9973 == 3 and 0 < i < 249_999 for at in (i - 1, i, i + 1) if (i - 1) % 3 and (i + 1) % 3}
    hit = {i for i in range(250_000) if i % 3} | around
    assert items[2][0] == len(hit) >= the_the and items[1][0] == len(hit) + 12 and items[1][1] == ["7", "8", "9"]


def test_proximity(spark, make_docs):
    docs = make_docs([(1, "gamma beta alpha"), (2, "alpha one two beta three gamma"), (3, "alpha beta"), (4, "alpha b c d e f g beta gamma")])
    phrases = decontam.passages(bench(spark, [(1, "alpha beta gamma")])).select("win", "phrase")
    near = lambda slack: sorted({r["key"]["id"] for r in decontam.proximity_matches(docs, phrases, slack).select("key").collect()})
    assert (near(0), near(2), near(3), near(6)) == ([1], [1], [1, 2], [1, 2, 4])


def test_proximity_counts_repeated_words(spark, make_docs):
    docs = make_docs([(1, "the x cat"), (2, "the cat the"), (3, "the cat x the"), (4, "the")])
    phrases = decontam.passages(bench(spark, [(1, "the the cat")])).select("win", "phrase")
    near = lambda slack: sorted({r["key"]["id"] for r in decontam.proximity_matches(docs, phrases, slack).select("key").collect()})
    assert (near(0), near(1)) == ([2], [2, 3])


def test_words(spark):
    got = spark.range(1).select(decontam.words(F.lit("The ÉtÉ's A1-b_c ß 日本 X"))).first()[0]
    assert got == brute.bench_words("The ÉtÉ's A1-b_c ß 日本 X")
