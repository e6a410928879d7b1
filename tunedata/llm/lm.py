"""Score documents by the cross-entropy difference of two n-gram models.

A target and a background model are matched: bigrams over one vocabulary, counted the same way on
two corpora and smoothed the same way (Witten-Bell, down to add-one unigrams). A document's score is
the mean over its tokens of the target's loss less the background's, in nats: the lower, the more it
reads like the target corpus.

Counts cover all words and bigrams of both corpora; words are told apart by 64-bit hashes, bigrams by
64-bit hashes of two of these. No table of them is held in one place:

1. Texts are read once and dealt into chunks of about ``CHUNK`` tokens. A chunk is a file in the shared
   folder: its words' hashes and its texts as numbers of these words.
2. Each chunk sends every bigram that it holds once, with its counts, to the bucket of the bigram's
   hash. The bucket adds up and answers in the order of the request, so an answer holds no keys. One
   chunk is told that a bigram is its own, and counts it among the kinds that follow its first word.
3. Words go the same way, with what follows them and how often they are met.
4. With both answers a chunk has all counts that its texts need.

A bucket gets a bigram once from a chunk, however often the chunk holds it, so no pair is too frequent.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tunedata.llm.text import free_name
from tunedata.session import cut_lineage, scratch_path

#: Words that a task counts before it hands them on.
HELD = 500_000
#: Tokens of a chunk (a longer text is one of its own), and requests that a bucket answers, on average.
CHUNK, BUCKET = 1 << 20, 1 << 19
#: What no word is: the start of a text and, in a limited vocabulary, the unknown word.
START, OTHER = " ", ""
#: Rows of the parts of a chunk: the texts counted for the target, answers about bigrams, answers about words.
PICKED, PAIRS, WORDS = 0, 1, 2

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def vocabulary(corpus: DataFrame, text_col: str, size: int) -> list[str]:
    """The most frequent words, ties by word; they are at most ``size`` - 2."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(words(text))
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())}).astype({"word": object, "n": "int64"})

    counted = corpus.select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.orderBy(F.col("n").desc(), "word").limit(size - 2).collect()]


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers of at least 0, in the fewest bytes each, byte by byte."""
    out = []
    for a in arrays:
        a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        data = zlib.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)
        out.append(struct.pack("<BQ", a.itemsize, len(data)) + data)
    return b"".join(out)


def _unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size, n = struct.unpack_from("<BQ", data, at)
        raw = np.frombuffer(zlib.decompress(data[at + 9:at + 9 + n]), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(size, -1).T).view(f"<u{size}").reshape(-1).astype(np.int64))
        at += 9 + n
    return out


def _hashes(found: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(found, categorize=False)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sum(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, n, size).astype(np.int64)


class _Chunk:
    """A chunk as read from its file. ``pairs`` numbers its bigrams, ``at`` is the bigram of each token."""

    def __init__(self, folder: str, name: str, picked: bytes):
        store, base = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{base}/{name}") as source:
            data = source.read()
        n_ids, n_numbers = struct.unpack_from("<QQ", data)
        self.ids = json.loads(zlib.decompress(data[16:16 + n_ids]))
        self.lengths, target, self.background, codes = _unpacked(data[16 + n_ids:16 + n_ids + n_numbers])
        self.words = np.frombuffer(data[16 + n_ids + n_numbers:], np.uint64)
        self.target = target.copy()
        if picked:
            self.target[np.array(picked.decode().split(","), np.int64)] = 1
        size, starts = len(self.words), np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[starts[self.lengths > 0]] = size - 1
        pairs, self.at = np.unique(before * size + codes, return_inverse=True)
        self.first, self.second = pairs // size, pairs % size
        self.texts = np.repeat(np.arange(len(self.lengths)), self.lengths)

    @cached_property
    def keys(self) -> np.ndarray:
        return _pair_hashes(self.words[self.first], self.words[self.second])

    def counts(self) -> list[np.ndarray]:
        """How often this chunk adds each of its bigrams to the target and to the background."""
        return [_sum(self.at, n[self.texts], len(self.first)) for n in (self.target, self.background)]


def _write(folder: str, name: str, ids: list, numbers: list[np.ndarray], hashes: np.ndarray) -> None:
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    names, packed = zlib.compress(json.dumps(ids).encode(), 1), _packed(*numbers)
    with store.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(struct.pack("<QQ", len(names), len(packed)) + names + packed + hashes.tobytes())


def chunks(rows: DataFrame, folder: str, vocab: list[str] | None = None) -> DataFrame:
    """Write (id, text, target, background) as chunks; (chunk, pos, id, pairs, words) for each row.

    ``target`` and ``background`` say how often a text counts in each. ``pairs`` and ``words`` are those
    of the whole chunk, at its first row, else 0. Only files that this table names are read, so what a
    repeated task leaves behind does no harm.
    """
    kept = rows.sparkSession.sparkContext.broadcast(frozenset(vocab)) if vocab is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = kept.value if kept else None
        ids, lengths, target, background, tokens = [], [], [], [], []

        def flush() -> pd.DataFrame:
            codes, found = pd.factorize(np.array(tokens, dtype=object))
            hashes = _hashes(np.append(found, START).astype(object))
            name = uuid.uuid4().hex
            _write(folder, name, ids, [np.array(x, np.int64) for x in (lengths, target, background, codes)], hashes)
            pairs = np.zeros(len(ids), np.int64)
            sizes = pairs.copy()
            pairs[0], sizes[0] = len(tokens), len(hashes)
            return pd.DataFrame({"chunk": name, "pos": np.arange(len(ids), dtype=np.int32), "id": list(ids), "pairs": pairs, "words": sizes})

        for batch in batches:
            for name, text, t, b in zip(batch["id"], batch["text"], batch["target"], batch["background"]):
                found = words(text)
                if known is not None:
                    found = [w if w in known else OTHER for w in found]
                if ids and len(tokens) + len(found) > CHUNK:
                    yield flush()
                    for held in (ids, lengths, target, background, tokens):
                        held.clear()
                ids.append(name)
                lengths.append(len(found))
                target.append(t)
                background.append(b)
                tokens += found
        if ids:
            yield flush()

    return cut_lineage(rows.select("id", "text", "target", "background").mapInPandas(run, "chunk string, pos int, id string, pairs long, words long"))


def _asked(folder: str, name: str, keys: np.ndarray, counts: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """What a chunk asks each bucket: the keys, and the counts that it adds to them."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    out = [(b, name, keys[i].tobytes(), _packed(*(n[i] for n in counts)))
           for b, i in enumerate(np.split(order, ends[:-1])) if len(i)]
    return pd.DataFrame(out, columns=["part", "chunk", "keys", "data"])


def _answered(parts: list[list[np.ndarray]], order: np.ndarray) -> list[np.ndarray]:
    """The answers of the buckets, in the order of the chunk."""
    out = []
    for column in zip(*parts):
        whole = np.empty(len(order), np.int64)
        whole[order] = np.concatenate(column)
        out.append(whole)
    return out


def _read(group: pd.DataFrame, folder: str, pair_buckets: int) -> tuple[_Chunk, list[np.ndarray]]:
    """A chunk and what it was told of its bigrams: target, background, own."""
    chunk = _Chunk(folder, group["chunk"].iat[0], group.loc[group["kind"] == PICKED, "data"].iat[0])
    told = group[group["kind"] == PAIRS].sort_values("part")
    order = np.argsort(chunk.keys % np.uint64(pair_buckets), kind="stable")
    return chunk, _answered([_unpacked(x) for x in told["data"]], order) if len(told) else [np.zeros(0, np.int64)] * 3


def _added(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The requests of a bucket by chunk, their ends, the sums of each key, first places and key of each entry."""
    group = group.sort_values("chunk", ignore_index=True)  # the same owners if a task is repeated
    ends = np.cumsum([len(x) // 8 for x in group["keys"]])
    keys, first, at = np.unique(np.frombuffer(b"".join(group["keys"]), np.uint64), return_index=True, return_inverse=True)
    counts = [np.concatenate(x) for x in zip(*(_unpacked(x) for x in group["data"]))]
    return group, ends, [_sum(at, n, len(keys)) for n in counts], first, at, keys


def scored(places: DataFrame, folder: str, picked: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """(id, lm_tokens, lm_score) of each row of ``places``, as ``chunks`` gave them.

    ``picked``: (chunk, pos) of rows that count in the target besides. ``size`` is that of a limited
    vocabulary, else all words of the corpora are in it.
    """
    entries = places.agg(F.sum("pairs"), F.sum("words"), F.count_if(F.col("words") > 0)).first()
    pair_buckets, word_buckets = (max(1, -(-(n or 0) // BUCKET)) for n in entries[:2])
    of_chunk = places.filter("pos = 0").select("chunk", F.lit(PICKED).alias("kind"), F.lit(0).cast("long").alias("part"))
    if picked is None:
        index = of_chunk.withColumn("data", F.lit(b""))
    else:
        listed = picked.groupBy("chunk").agg(F.array_join(F.collect_set("pos").cast("array<string>"), ",").cast("binary").alias("listed"))
        index = of_chunk.join(listed, "chunk", "left").select("chunk", "kind", "part", F.coalesce("listed", F.lit(b"")).alias("data"))
    index = cut_lineage(index)
    part_type = "chunk string, kind int, part long, data binary"

    def ask_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, picks in zip(batch["chunk"], batch["data"]):
                chunk = _Chunk(folder, name, picks)
                yield _asked(folder, name, chunk.keys, chunk.counts(), pair_buckets)

    def tell_pairs(group: pd.DataFrame) -> pd.DataFrame:
        group, ends, sums, first, at, keys = _added(group)
        own = np.zeros(len(at), np.int64)
        own[first] = 1
        told = [_packed(*(n[i] for n in sums), own[low:high]) for low, high, i in zip([0, *ends[:-1]], ends, np.split(at, ends[:-1]))]
        return pd.DataFrame({"chunk": group["chunk"], "kind": PAIRS, "part": group["part"], "data": told})

    def ask_words(group: pd.DataFrame) -> pd.DataFrame:
        chunk, (target, background, own) = _read(group, folder, pair_buckets)
        n = len(chunk.words)
        counts = []
        for here, whole in zip(chunk.counts(), (target, background)):
            counts += [_sum(chunk.second, here, n), _sum(chunk.first, here, n), _sum(chunk.first, own * (whole > 0), n)]
        return _asked(folder, group["chunk"].iat[0], chunk.words, counts, word_buckets)

    def tell_words(group: pd.DataFrame) -> pd.DataFrame:
        group, ends, sums, _, at, _ = _added(group)
        told = [_packed(*(n[i] for n in sums)) for i in np.split(at, ends[:-1])]
        out = pd.DataFrame({"chunk": group["chunk"], "kind": WORDS, "part": group["part"], "data": told, "known": 0, "target": 0, "background": 0})
        out.loc[0, ["known", "target", "background"]] = [int(((sums[0] > 0) | (sums[3] > 0)).sum()), int(sums[0].sum()), int(sums[3].sum())]
        return out

    request = "part long, chunk string, keys binary, data binary"
    spread = index.repartition(max(1, -(-entries[2] // 2)), "chunk")
    pairs = cut_lineage(spread.select("chunk", "data").mapInPandas(ask_pairs, request).groupBy("part").applyInPandas(tell_pairs, part_type))
    told = cut_lineage(index.union(pairs).groupBy("chunk").applyInPandas(ask_words, request).groupBy("part").applyInPandas(
        tell_words, part_type + ", known long, target long, background long"))
    totals = told.agg(F.sum("known"), F.sum("target"), F.sum("background")).first()
    known, *tokens = (n or 0 for n in totals)
    vocabulary_size = size or known + 2

    def score(group: pd.DataFrame) -> pd.DataFrame:
        chunk, (target, background, _) = _read(group, folder, pair_buckets)
        total = np.zeros(len(chunk.ids))
        if len(chunk.at):
            answers = [_unpacked(x) for x in group[group["kind"] == WORDS].sort_values("part")["data"]]
            met = _answered(answers, np.argsort(chunk.words % np.uint64(word_buckets), kind="stable"))
            value = np.zeros(len(chunk.first))
            for sign, pair, whole, (single, after, kinds) in zip((-1, 1), (target, background), tokens, (met[:3], met[3:])):
                unigram = ((single + 1) / (whole + vocabulary_size))[chunk.second]
                after, kinds = after[chunk.first], kinds[chunk.first]
                value += sign * np.log(np.where(after > 0, (pair + kinds * unigram) / np.maximum(after + kinds, 1), unigram))
            total = np.bincount(chunk.texts, value[chunk.at], len(chunk.ids))
        means = np.where(chunk.lengths > 0, total / np.maximum(chunk.lengths, 1), np.nan)
        return pd.DataFrame({"id": pd.Series(chunk.ids, dtype=object), "lm_tokens": chunk.lengths, "lm_score": pd.Series(means).astype("Float64").mask(chunk.lengths == 0)})

    return index.union(pairs).union(told.select("chunk", "kind", "part", "data")).groupBy("chunk").applyInPandas(
        score, "id string, lm_tokens long, lm_score double")


def score_members(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lm_tokens, lm_score) of every row of ``docs``, which are the background; those whose id is in ``members`` are the target.

    Ids and members are merged, never broadcast, at any size; texts do not move.
    """
    folder = scratch_path(docs.sparkSession, "chunks")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    places = chunks(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), none.alias("target"), one.alias("background")), folder)
    wanted = members.select(F.col(id_col).cast("string").alias("id")).hint("merge")
    picked = places.select("chunk", "pos", "id").join(wanted, "id", "left_semi").select("chunk", "pos")
    out = scored(places, folder, picked)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "lm_tokens", "lm_score")


@dataclass(frozen=True)
class Models:
    """Two corpora to be counted with what is scored, as (text), and the vocabulary where it is limited."""

    target: DataFrame
    background: DataFrame
    vocab: list[str] | None
    size: int | None


def fit(target: DataFrame, background: DataFrame, text_col: str = "text", size: int | None = None) -> Models:
    """Null and empty texts add nothing; an empty corpus gives an even model.

    All words of both corpora are in the vocabulary, unless ``size`` asks for the ``size`` - 2 most
    frequent ones of the background, all others being one unknown word.
    """
    vocab = vocabulary(background, text_col, size) if size is not None else None
    return Models(target.select(F.col(text_col).alias("text")), background.select(F.col(text_col).alias("text")), vocab, size)


def with_score(df: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """Adds lm_tokens and lm_score; columns of those names are replaced.

    Null and empty texts, and such without a word, have 0 tokens and a null score. Rows, other columns
    and repeats stay as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat_ws(":", F.xxhash64(text), F.xxhash64(F.lit("2"), text))
    rows = df.select(key.alias("id"), text.alias("text"), F.lit(0).cast("long").alias("target"), F.lit(0).cast("long").alias("background"))
    for corpus, n in ((models.target, (1, 0)), (models.background, (0, 1))):
        rows = rows.union(corpus.select(F.lit(None).cast("string"), "text", *[F.lit(x).cast("long") for x in n]))
    folder = scratch_path(df.sparkSession, "chunks")
    found = scored(chunks(rows, folder, models.vocab), folder, size=models.size).filter("id IS NOT NULL")
    own = free_name(df, "_scored")
    once = found.groupBy(F.col("id").alias(own)).agg(F.first("lm_tokens").alias("lm_tokens"), F.first("lm_score").alias("lm_score"))
    left = df.withColumn(own, key).drop("lm_tokens", "lm_score")
    return left.join(once, own, "left").drop(own)
