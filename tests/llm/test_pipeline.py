import random

import brute
import pytest

import __spark_entry__
import corpus_pipeline as cp
from tunedata.llm import langid, text
from tunedata.session import cut_lineage, scratch_path


@pytest.fixture(scope="module")
def folder(spark):
    path = scratch_path(spark, "tables")
    spark.createDataFrame([(1, "a passage of ten words that no document should ever hold"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def sentences(seed, n=12):
    rng = random.Random(seed)
    words = "the of and sea ship line clear wind water over under about great small house river stone light".split()
    return "\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, sentences(i), f"src{i % 3}", "en") for i in range(20)]
    near = sentences(0).split(" ")
    near[50] = "changed"
    out += [(40, sentences(1), "src1", "en"), (41, " ".join(near), "src1", "en"), (42, sentences(70) + "\nA passage of ten words that no document should EVER hold!", "src0", "en"),
            (43, None, "src0", "en"), (44, "", None, None), (45, "12 34", "src0", "en"), (3, sentences(3), "src0", "en"), (None, sentences(80), None, "en"),
            (46, sentences(90) + "\n" + sentences(5), "src2", "en")]
    return out


def test_stages(spark, folder, make_docs, rows):
    docs = make_docs(rows)
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        docs = cut_lineage(stage(spark, docs, folder))
        seen.append(docs.collect())
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    language, lines, near, clean, mixed = seen
    assert sorted((r["doc_id"], r["text"]) for r in language if r["doc_id"] is not None) == sorted((i, t) for i, t, *_ in rows if i is not None and i not in (43, 44, 45) and t)
    given = [(r["doc_id"], r["text"]) for r in language]
    want = {k: v for k, v in brute.dedup_lines(given).items() if v.strip()}
    assert {(r["doc_id"], r["text"]) for r in lines} == {(k[0], v) for k, v in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    given = [(r["doc_id"], r["text"]) for r in lines]
    groups = brute.near_duplicates(given, 5, 80)
    assert {r["doc_id"] for r in near} == {c for _, c in groups} and len(near) == len({c for _, c in groups})
    assert {r["doc_id"] for r in near} - {r["doc_id"] for r in clean} == {42}
    assert sorted(map(repr, (r["doc_id"] for r in mixed))) == sorted(map(repr, (r["doc_id"] for r in clean)))


def test_near_dedup_keeps_one_row_of_each_group(spark, folder, make_docs):
    a, b = sentences(1), sentences(2)
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b + " x"), (7, None), (7, None), (8, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, make_docs(rows), folder).collect()), key=repr)
    assert len([g for g in got if g[1] == a]) == 1 and (1, a) in got
    assert len([g for g in got if g[0] is None]) == 1
    assert [g for g in got if not g[1]] == [(7, None), (7, None), (8, "")]


def test_decontamination(spark, folder, make_docs):
    texts = [(1, "nothing of it"), (2, "x a passage of ten words that no document should ever"), (2, None), (3, "a passage of ten words"), (4, "a passage of nine words")]
    assert sorted((r["doc_id"], r["text"]) for r in cp.decontaminate(spark, make_docs(texts), folder).collect() if r["text"]) == [
        (1, "nothing of it"), (3, "a passage of ten words"), (4, "a passage of nine words")]


def test_empty(spark, folder, make_docs):
    docs = make_docs([])
    for _, stage in cp.STAGES:
        docs = cut_lineage(stage(spark, docs, folder))
    assert docs.count() == 0


def test_run(spark, sf_dir):
    out = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    total = out.agg({"taken": "sum", "size": "sum"}).first()
    assert abs(total["sum(taken)"] - 1.5 * total["sum(size)"]) <= 30
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]


def test_language_rejects_noise(spark, make_docs):
    rng = random.Random(3)
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(200))
    docs = make_docs([(i, sentences(i), "s", "en") for i in range(10)] + [(50, noise, "s", None)])
    marked = langid.with_language(docs, langid.fit(docs))
    assert {r["doc_id"] for r in marked.filter(~langid.is_language()).collect()} <= {50}


def test_free_name(make_docs):
    assert text.free_name(make_docs([]), "KEY") == "_KEY"
