import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tunedata.llm import tokens
from tunedata.llm.queries import QUERIES
from tunedata.session import cut_lineage

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return tokens.PrefixCounter(PATH)


def texts(n):
    rng = random.Random(11)
    signs = "ab eéñ▁ 日本語x\n\t<s>/🙂thein  .,'-0"
    return ["", " ", "<s>x</s>", "y" * 5000, "▁", "x\0y"] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_every_prefix(model, counter):
    for text in texts(400):
        table = counter.prefixes(text)
        assert [counter.at(table, n) for n in range(min(len(text), 40) + 1)] == [len(model.encode(text[:n])) for n in range(min(len(text), 40) + 1)]
        assert counter.count(text) == len(model.encode(text))


def test_longest_prefix(model, counter):
    for text in texts(300):
        if len(text) < 50:
            for budget in (0, 1, 3, 8):
                want = max(n for n in range(len(text) + 1) if len(model.encode(text[:n])) <= budget)
                assert counter.longest_prefix(counter.prefixes(text), budget) == want


def test_query(spark, sf_dir, model):
    got = {r["doc_id"]: r for r in QUERIES["op1_token_counts"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n = len(model.encode(r["text"] or ""))
        row = got[r["doc_id"]]
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len((r["text"] or "").encode()), n, n > 4096)


def test_columns(make_docs, model):
    docs = make_docs([(1, None), (2, ""), (3, "the heat of it"), (3, "the heat of it"), (None, "x")])
    counted = tokens.with_token_counts(docs, PATH, into="size")
    assert counted.columns == docs.columns
    assert sorted(r["size"] for r in counted.collect()) == sorted(len(model.encode(t)) for t in ("", "", "the heat of it", "the heat of it", "x"))
    cut = tokens.truncate(docs, PATH, 2).collect()
    assert [r["text"] for r in cut][:2] == [None, ""] and all(len(model.encode(r["text"] or "")) <= 2 for r in cut)
    first = tokens.with_prefix_count(docs.withColumn("n", F.lit(5)), PATH, "n").collect()
    assert [r["n_tokens"] for r in first] == [len(model.encode((r["text"] or "")[:5])) for r in first]
    last = tokens.with_prefix_table(docs, PATH).select(F.try_element_at("prefix_tokens", F.lit(-1))["tokens"].alias("n")).collect()
    assert [r["n"] or 0 for r in last] == [len(model.encode(r["text"] or "")) for r in docs.collect()]
    assert tokens.with_token_counts(make_docs([]), PATH).count() == 0


def test_stored_counts_of_every_prefix(model, counter):
    for text in texts(300) + ["x" * 300 + " heat of it" * 40, "of" * 400]:
        counts = tokens.stored_counts(counter.steps(text)).tolist()
        assert len(counts) == len(text) + 1
        for n in {*range(min(len(text), 40) + 1), len(text)}:
            assert counts[n] == len(model.encode(text[:n]))
    large = tokens.stored_counts(b"\1" + np.array([300, -200], "<i2").tobytes())
    assert large.tolist() == [0, 300, 100]


def test_stored_tables_answer_without_a_tokenizer(make_docs, model, monkeypatch):
    rows = [(1, None), (2, ""), (3, "the heat of it"), (3, "the heat of it"), (None, "x 🙂 é" * 50), (4, "the <s> of\n the"), (5, "heat " * 30_000)]
    stored = cut_lineage(tokens.with_prefix_counts(make_docs(rows), PATH))
    monkeypatch.setattr(tokens, "counter", None)  # what follows must not need one

    class Gone:
        def __init__(self, *_, **__):
            raise AssertionError("the tokenizer was asked")

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Gone)
    all_of = {(r["doc_id"], r["text"]): r["n_tokens"] for r in tokens.count_stored(stored).collect()}
    first = {(r["doc_id"], r["text"]): r["n_tokens"] for r in tokens.count_stored(stored.withColumn("n", F.lit(6)), "n").collect()}
    none = tokens.count_stored(stored.withColumn("n", F.lit(None).cast("int")), "n").filter("n_tokens > 0").count()
    assert none == 0
    for key in rows:
        assert all_of[key] == len(model.encode(key[1] or "")) and first[key] == len(model.encode((key[1] or "")[:6]))
    for budget in (0, 1, 3, 1000):
        cut = tokens.truncate_stored(stored, budget)
        assert cut.columns == stored.columns
        got = sorted((r["text"] for r in cut.collect()), key=repr)
        want = []
        for _, text in rows:
            lengths = range(len(text) + 1) if text and len(text) < 400 else [min(5 * budget + k, len(text or "")) for k in range(-6, 7) if 5 * budget + k >= 0]
            want.append(text and text[:max(n for n in lengths if len(model.encode(text[:n])) <= budget)])
        assert got == sorted(want, key=repr)
