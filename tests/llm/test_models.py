import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunedata.llm import langid, lm
from tunedata.llm.queries import QUERIES


def train(spark, rows):
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    joined = QUERIES["op8_language_id"](spark, sf_dir).join(docs, "doc_id")
    right = joined.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    for r in joined.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))


def test_code_lengths(spark):
    """Against contexts kept in dictionaries, one byte after the other."""
    texts = {"a": ["the cat sat on the mat", "that hat"], "b": ["das ist die katze", "auf der matte, ß"]}
    model = train(spark, [(i * 10 + j, t, lang) for i, (lang, ts) in enumerate(texts.items()) for j, t in enumerate(ts)])
    assert model.languages == ["a", "b"]
    seen = {b for ts in texts.values() for t in ts for b in t.encode()}

    def cost(lang, text):
        follow = [defaultdict(Counter) for _ in range(4)]
        for t in texts[lang]:
            data = [-1] * 3 + list(t.encode())
            for i in range(3, len(data)):
                for k in range(4):
                    follow[k][tuple(data[i - k:i])][data[i]] += 1

        def share(context):
            if context is None:
                return {b: 1 / 256 for b in seen} | {None: (256 - len(seen)) / 256}
            counts = follow[len(context)].get(context, {})
            below = share(context[1:] if context else None)
            total, kinds = sum(counts.values()), len(counts)
            if not kinds:
                return below
            left = 1 - sum(p for b, p in below.items() if b in counts)
            return {b: counts[b] / (total + kinds) if b in counts else kinds / (total + kinds) * p / left for b, p in below.items()}

        data, bits = [-1] * 3 + list(text.encode()), 0
        for i in range(3, len(data)):
            p = share(tuple(x if x in seen or x == -1 else None for x in data[i - 3:i]))
            bits -= math.log2(p[data[i] if data[i] in seen else None])
        return bits

    asked = ["the mat", "die matte", "xyz\0", "", "ß the"]
    got = model.bits([t.encode() for t in asked])
    assert np.allclose(got, [[cost(lang, t) for lang in "ab"] for t in asked], atol=1e-3)


def test_pieces_do_not_matter(spark, monkeypatch):
    model = train(spark, [(1, "the cat sat", "a"), (2, "die katze", "b")])
    rng = random.Random(1)
    texts = ["".join(rng.choice("the catdizk\0") for _ in range(rng.randint(0, 40))).encode() for _ in range(50)]
    whole = model.bits(texts)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert np.allclose(model.bits(texts), whole)


def test_every_language_is_learned(spark, make_docs, monkeypatch):
    """70 labels, each with an alphabet of its own; the rarest come last by name and by count."""
    texts = {f"l{i:02}": " ".join(chr(0x4E00 + 40 * i + j) * 2 for j in range(12)) for i in range(70)}
    rows = [(1000 * i + j, text, lang) for i, (lang, text) in enumerate(texts.items()) for j in range(2 if i < 64 else 1)]
    model = train(spark, rows)
    assert model.languages == sorted(texts)
    got = langid.with_language(make_docs([(i, t, lang) for i, (lang, t) in enumerate(texts.items())]), model).collect()
    assert [r["lang_pred"] for r in got] == [r["source"] for r in got] and len(got) == 70
    asked = [t.encode() for t in [*texts.values(), "plain", "一x"]]
    apart = model.bits(asked)
    monkeypatch.setattr(langid, "GROUP", 70)
    model.held.clear()
    assert np.allclose(model.bits(asked), apart, rtol=1e-5)


def test_equal_code_lengths_go_to_the_first_language(spark, make_docs):
    model = train(spark, [(1, "the cat sat", "b"), (2, "the cat sat", "a"), (3, "the cat sat", "c")])
    got = langid.with_language(make_docs([(1, "the cat"), (2, "zebra 日本")]), model).collect()
    assert [r["lang_pred"] for r in got] == ["a", "a"] and all(abs(r["score"] - 1 / 3) < 1e-9 for r in got)


def test_sample_is_that_of_the_smallest_hashes(spark):
    """Far more rows than wanted, one id repeated in a third of them, and a language of few rows."""
    rows = [(i, f"word{i} of text {i * 7}", "a") for i in range(2000)] + [(9000 + i, f"quelques mots {i}", "b") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = [r["doc_id"] for r in df.filter("lang = 'a'").orderBy(F.xxhash64("doc_id")).limit(20).collect()]
    hot = df.unionByName(spark.createDataFrame([(first[0], f"word{first[0]} of text {first[0] * 7}", "a")] * 1000, df.schema)).repartition(16)
    got = langid.fit(hot, sample_rows=20)
    want = langid.fit(df.filter(F.col("doc_id").isin(first) | (F.col("lang") == "b")), sample_rows=10_000)
    assert got.languages == want.languages == ["a", "b"]
    for name in ("language", "gram", "count"):
        assert (getattr(got, name) == getattr(want, name)).all()


def test_tables_do_not_depend_on_how_many_contexts_are_made_together(spark, monkeypatch):
    model = train(spark, [(1, "the cat sat on the mat", "a"), (2, "die katze sass", "b")])
    asked = [b"the mat", b"die katze", "é日".encode(), b"q"]
    whole = model.bits(asked)
    monkeypatch.setattr(langid, "CONTEXTS", 3)
    model.held.clear()
    assert (model.bits(asked) == whole).all()


def test_odd_texts(spark, make_docs):
    model = train(spark, [(1, "the cat sat", "a"), (2, "die katze", "b"), (3, None, "c"), (None, "x", "d"), (4, "y", None)])
    docs = make_docs([(1, None), (2, ""), (3, "12 !!"), (4, "the the"), (4, "the the"), (None, "日本")])
    out = langid.with_language(docs, model)
    got = [(r["lang_pred"], r["score"]) for r in out.collect()]
    assert [g[0] for g in got][:3] == ["und"] * 3 and got[0][1] == 0 and got[3] == got[4] and got[3][0] == "a" and got[5][0] in "ab"
    assert out.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "bits_per_byte"]
    nothing = train(spark, [])
    assert {r["lang_pred"] for r in langid.with_language(docs, nothing).collect()} == {"und"}
    assert langid.with_language(make_docs([]), model).count() == 0


def lm_score(target, background, text, vocab):
    """Witten-Bell bigrams in dictionaries."""
    losses = []
    for corpus in (target, background):
        pairs, after, single = Counter(), defaultdict(Counter), Counter()
        for t in corpus:
            prev = "<s>"
            for w in lm.words(t):
                w = w if w in vocab else "<u>"
                pairs[prev, w] += 1
                after[prev][w] += 1
                single[w] += 1
                prev = w
        total, loss, prev = sum(single.values()), 0, "<s>"
        for w in lm.words(text):
            w = w if w in vocab else "<u>"
            base = (single[w] + 1) / (total + 8)
            n, kinds = sum(after[prev].values()), len(after[prev])
            loss -= math.log((pairs[prev, w] + kinds * base) / (n + kinds) if n else base)
            prev = w
        losses.append(loss)
    return (losses[0] - losses[1]) / len(lm.words(text))


def test_cross_entropy_difference(spark, make_docs):
    rng = random.Random(9)
    background = [" ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(0, 20))) for _ in range(40)] + [None, ""]
    target = background[:12]
    models = lm.fit(make_docs(list(enumerate(target))), make_docs(list(enumerate(background))), size=8)
    counts = Counter(w for t in background for w in lm.words(t))
    assert models.vocab == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:6]]
    out = lm.with_score(make_docs(list(enumerate(background)) + [(99, "zzz A b"), (99, "zzz A b"), (None, "!")]), models).collect()
    for r in out:
        if lm.words(r["text"]):
            assert r["lm_tokens"] == len(lm.words(r["text"]))
            assert abs(r["lm_score"] - lm_score(target, background, r["text"], set(models.vocab))) < 1e-4
        else:
            assert r["lm_score"] is None and r["lm_tokens"] == 0
    none = lm.fit(make_docs([]), make_docs([]), size=8)
    assert [r["lm_score"] for r in lm.with_score(make_docs([(1, "a b")]), none).collect()] == [pytest.approx(0)]


def test_scores_tell_the_corpora_apart(spark, make_docs):
    good = [(i, "a clear line about the sea and the ships") for i in range(20)]
    bad = [(i, "buy now cheap cheap offer click here") for i in range(20, 60)]
    models = lm.fit(make_docs(good), make_docs(good + bad))
    got = {r["doc_id"]: r["lm_score"] for r in lm.with_score(make_docs(good[:1] + bad[:1]), models).collect()}
    assert got[0] < 0 < got[20]


def test_every_word_is_counted(spark, make_docs, monkeypatch):
    """6,000 words, each met twice, against dictionaries; chunks and buckets of a few words."""
    monkeypatch.setattr(lm, "CHUNK", 900)
    monkeypatch.setattr(lm, "BUCKET", 700)
    rng = random.Random(4)
    texts = [" ".join(f"w{j}" for j in rng.sample(range(i % 10, 6000, 10), 60)) + " the end the end" for i in range(200)]
    rows = list(enumerate(texts)) + [(200, None), (201, "!"), (7, texts[7]), (None, "w1 w2")]
    docs, good = make_docs(rows), spark.createDataFrame([(i,) for i in [*range(0, 200, 3), 0, 999]] + [(None,)], "doc_id long")
    plain = [t for _, t in rows]
    target = [t for i, t in rows if i is not None and i < 200 and i % 3 == 0]
    words = {w for t in plain for w in lm.words(t)}
    assert len(words) > 4096

    corpora = []
    for corpus in (target, plain):
        pairs, single = Counter(), Counter()
        for t in corpus:
            found = lm.words(t)
            pairs.update(zip(["<s>", *found], found))
            single.update(found)
        after, kinds = Counter(), Counter()
        for (a, _), n in pairs.items():
            after[a] += n
            kinds[a] += 1
        corpora.append((pairs, single, after, kinds, sum(single.values())))

    def expected(text):
        found, losses = lm.words(text), []
        for pairs, single, after, kinds, total in corpora:
            loss = 0
            for a, b in zip(["<s>", *found], found):
                base = (single[b] + 1) / (total + len(words) + 2)
                loss -= math.log((pairs[a, b] + kinds[a] * base) / (after[a] + kinds[a]) if after[a] else base)
            losses.append(loss)
        return (losses[0] - losses[1]) / len(found)

    out = lm.score_members(docs, good).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((i is None, i or 0) for i, _ in rows)
    by_id = dict(rows)
    for r in out:
        found = lm.words(by_id[r["doc_id"]])
        assert r["lm_tokens"] == len(found)
        assert r["lm_score"] == pytest.approx(expected(by_id[r["doc_id"]]), abs=1e-9) if found else r["lm_score"] is None
    models = lm.fit(make_docs([(i, t) for i, t in enumerate(target)]), docs)
    again = lm.with_score(docs, models).collect()
    assert len(again) == len(rows)
    for r in again:
        assert r["lm_score"] == pytest.approx(expected(r["text"]), abs=1e-9) if lm.words(r["text"]) else r["lm_score"] is None
