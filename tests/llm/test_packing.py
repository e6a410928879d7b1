import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tunedata.llm import packing
from tunedata.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def windows_of(lengths, window):
    """Best fit decreasing, piece by piece: what is used of each window."""
    used = []
    for n in sorted(lengths, reverse=True):
        fits = [u for u in used if u + n <= window]
        if fits:
            used.remove(max(fits))
            used.append(max(fits) + n)
        else:
            used.append(n)
    return sorted(used)


def placed(lengths, window):
    by_length, at = defaultdict(list), defaultdict(list)
    for n, rank, first, each, offset in packing.best_fit_plan(Counter(lengths), window):
        by_length[n].append((rank, first, each, offset))
    for n, count in Counter(lengths).items():
        for rank in range(count):
            begin, first, each, offset = [run for run in by_length[n] if run[0] <= rank][-1]
            at[first + (rank - begin) // each].append((offset + (rank - begin) % each * n, n))
    assert sorted(at) == list(range(len(at)))
    for parts in at.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
    return sorted(sum(n for _, n in parts) for parts in at.values())


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, w), max_size=70))))
def test_plan_is_best_fit_decreasing(case):
    window, lengths = case
    assert placed(lengths, window) == windows_of(lengths, window)


def test_plan_of_many_pieces():
    rng = random.Random(1)
    plan = packing.best_fit_plan({n: rng.randrange(1, 10**9) for n in range(1, 2049)})
    assert len(plan) < 3 * 2048 * 64
    with pytest.raises(ValueError):
        packing.best_fit_plan({2049: 1})


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


signs = st.lists(st.sampled_from([
    *"ab AZ\n\t.,'\"19é世 　​\x1c\x85ß×÷İǅɏ", "foo", "Bar,", "x.\ny", "a|b", "endoftext|>", "<|", "<|endoftext|>", " <|endoftext|> ",
    "'s", "'ll ", "  ", "🙂", " ʰ", "\r\n", " ́x", "ა "]), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(signs)
def test_ids_are_those_of_the_library(text):
    ours = packing.tokenizer(PATH).ids(text)
    assert list(array("I", ours)) == library(text)


def test_kept_words_are_cleared(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_PARTS", 3)
    monkeypatch.setattr(packing, "KEPT_WORDS", 2)
    t = packing.PartTokenizer(PATH)
    for text in ("one two three four five six, seven one two", "one two", "one,\ntwo three"):
        assert list(array("I", t.ids(text))) == library(text)


def check(rows, given_rows, window=2048):
    """Pieces hold every id of each text once, and windows have no gaps; (tokens, padding)."""
    at, starts = defaultdict(list), defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
        starts[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for doc_id, text in given_rows.items():
        ids = array("I", [*library(text), 1])
        end = 0
        for start, length, crc, tokens in sorted(starts[doc_id]):
            assert start == end and tokens == len(ids) and crc == zlib.crc32(ids[start:start + length].tobytes())
            end += length
        assert end == len(ids)
    tokens = padding = 0
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        tokens += end
        padding += 0 if end & (end - 1) == 0 else window - end
    return tokens, padding


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tokens, padding = check(QUERIES["op12_pack"](spark, sf_dir).collect(), docs)
    assert padding < max(2 * 2048, tokens / 200)  # the last windows of a small table are not full


def test_cases(spark):
    long = "word and <|endoftext|> more " * 60_000
    rows = [(1, None), (2, ""), (3, long), (4, "x"), (4, "x"), (None, "y"), (5, "é" * 300_000), *((i, "same text again") for i in range(100, 3000))]
    df = spark.createDataFrame([(*r, 9, 9, "p") for r in rows], "doc_id long, text string, row long, chunk long, piece string")
    pieces = packing.token_pieces(df, PATH, with_ids=True)
    packed = packing.pack(pieces.select("doc_id", "row", "chunk", "piece.*"))
    assert packed.columns == ["doc_id", "row", "chunk", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
    found = packed.collect()
    count = Counter(r["doc_id"] for r in found)
    assert count[4] == 2 and count[None] == 1 and count[1] == count[2] == 1 and len({(r["sequence_id"], r["offset"]) for r in found}) == len(found)
    whole = packing.sequences(packed, pad_id=0).collect()
    joined = defaultdict(dict)
    for r in found:
        joined[r["sequence_id"]][r["offset"]] = r["ids"]
    for r in whole:
        used = [i for _, part in sorted(joined[r["sequence_id"]].items()) for i in part]
        even = len(used) & (len(used) - 1) == 0
        assert r["n_tokens"] == len(used) and r["ids"] == used + [0] * (0 if even else 2048 - len(used))
    empty = packing.pack(packing.token_pieces(df.limit(0), PATH).select("doc_id", "piece.*"))
    assert empty.count() == 0
    without = packing.token_pieces(df.filter("doc_id < 3"), PATH, end_id=None)
    assert without.count() == 0
    lengths = spark.createDataFrame([(None, 5), (None, 0), (1, None), (1, 3), (1, 3)], "id long, length int")
    got = packing.pack(lengths, window=8).collect()
    assert sorted((r["length"] or 0, r["sequence_id"] is None) for r in got) == [(0, True), (0, True), (3, False), (3, False), (5, False)]
    with pytest.raises(ValueError):
        packing.pack(lengths, window=4)
