"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: what followed the last three, two, one and no bytes in
its training texts. A byte seen in the longest context known costs its share there; any other
escapes to the next shorter context, in which what the longer one holds is left out, down to an even
share among all bytes. The statistics are frozen after training, so the cost of a byte depends only
on the three before it, and the trees become one table (context, byte) -> bits per language. The
language with the shortest code for the whole text wins.

The trees are trained on a bounded sample: ``sample_rows`` whole texts per language, those with the
smallest hash of their id, for every language. Tables are made for ``GROUP`` languages at a time, some contexts
after the others, and groups are held up to ``HELD_BYTES``, so that memory does not grow with the number of
languages, but for their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tunedata.session import cut_lineage

ORDER = 3
SAMPLE_ROWS = 400
#: Languages that share tables, bytes of tables that a worker holds, contexts worked out together, and languages whose samples are broadcast.
GROUP, HELD_BYTES, CONTEXTS, FEW = 8, 256 << 20, 1024, 64
UNKNOWN = "und"
#: A text that no language codes shorter than its plain bytes is in none.
MAX_BITS = 8.0
#: Bytes scored at once.
PIECE = 1 << 19


def _shares(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Share of each byte in some contexts (contexts x bytes x languages), from what was counted there and the shares in their next shorter contexts."""
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    left = 1 - (below * (counts > 0)).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(total > 0, kinds / (total + kinds), 1.0)
        return np.where(counts > 0, counts / (total + kinds), np.where(left > 1e-12, escape * below / left, 0))


@dataclass
class Model:
    """Counts of four-byte sequences per language, packed as (language, sequence, count)."""

    languages: list[str]
    language: np.ndarray
    gram: np.ndarray
    count: np.ndarray

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("classes", "held")}

    @cached_property
    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(class of a byte, bytes seen), the same for all languages.

        Class 0 is the start of a text, the last one all bytes that were not seen in training.
        """
        symbols = np.unique(np.concatenate([np.unique((self.gram >> s) & 0x1FF) for s in (27, 18, 9, 0)]))  # 9 bits each; 256 is the start
        seen = symbols[symbols < 256]
        classes = np.full(257, len(seen) + 1)
        classes[seen], classes[256] = np.arange(1, len(seen) + 1), 0
        return classes.astype(np.int64), seen

    @cached_property
    def held(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {}

    def tables(self, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``GROUP`` languages from ``low`` on. The first groups are held, others made again."""
        if low not in self.held:
            made = self.made(low, min(low + GROUP, len(self.languages)))
            if sum(a.nbytes for two in (*self.held.values(), made) for a in two) > HELD_BYTES and self.held:
                return made
            self.held[low] = made
        return self.held[low]

    def made(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(context number of three classes, bits of context * classes + class by language) for languages low to high.

        A context that none of them has seen costs what the next shorter one does, so other languages change nothing.
        """
        classes, seen = self.classes
        size, n_lang = len(seen) + 2, high - low
        own_rows = (self.language >= low) & (self.language < high)
        language, count = self.language[own_rows] - low, self.count[own_rows]
        grams = classes[np.stack([(self.gram[own_rows] >> s) & 0x1FF for s in (27, 18, 9, 0)], 1)]
        # Order -1: an even share of all bytes; the last class stands for the bytes it holds, the start is never coded.
        share = np.full((1, size, n_lang), 1 / 256)
        share[0, -1], share[0, 0] = (256 - len(seen)) / 256, 0
        parent_of = np.zeros(1, np.int64)
        codes = []
        for order in range(ORDER + 1):
            code = np.zeros(len(grams), np.int64)
            for i in range(ORDER - order, ORDER):
                code = code * size + grams[:, i]
            codes.append(np.unique(code, return_inverse=True))
        bits = np.empty((sum(len(contexts) for contexts, _ in codes), size, n_lang), np.float32)
        numbers, offset = [], 0
        for order, (contexts, at) in enumerate(codes):
            parent_code = contexts % size ** max(order - 1, 0)
            parent = np.searchsorted(parent_of, parent_code) if order else np.zeros(1, np.int64)
            sequence = np.argsort(at, kind="stable")
            begins = np.searchsorted(at[sequence], np.arange(0, len(contexts) + CONTEXTS, CONTEXTS))
            own_share = np.empty((len(contexts), size, n_lang)) if order < ORDER else None
            for part, first in enumerate(range(0, len(contexts), CONTEXTS)):
                last, rows = min(first + CONTEXTS, len(contexts)), sequence[begins[part]:begins[part + 1]]
                counts = np.zeros((last - first, size, n_lang))
                np.add.at(counts, (at[rows] - first, grams[rows, ORDER], language[rows]), count[rows])
                own = _shares(counts, share[parent[first:last]])
                if own_share is not None:
                    own_share[first:last] = own
                with np.errstate(divide="ignore"):
                    cost = -np.log2(own)
                bits[offset + first:offset + last] = np.where(np.isfinite(cost), cost, 0)
            share = own_share
            numbers.append((contexts, offset))
            offset += len(contexts)
            parent_of = contexts
        state = np.zeros(size ** ORDER, np.int32)
        full = np.arange(size ** ORDER)
        for order, (contexts, start) in enumerate(numbers):
            code = full % size ** order
            at = np.minimum(np.searchsorted(contexts, code), len(contexts) - 1)
            state = np.where(contexts[at] == code, start + at, state).astype(np.int32)
        return state, bits.reshape(-1, n_lang)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each text takes in each language."""
        return np.concatenate([self._bits(texts, low) for low in range(0, len(self.languages), GROUP)], 1)

    def _bits(self, texts: list[bytes], group: int) -> np.ndarray:
        (classes, seen), (state, bits) = self.classes, self.tables(group)
        size = len(seen) + 2
        out = np.zeros((len(texts), bits.shape[1]))
        lengths = np.array([len(t) + ORDER for t in texts], np.int64)
        ends = np.cumsum(lengths)
        marks = (ends - lengths)[:, None] + np.arange(ORDER)
        raw = np.frombuffer(b"".join(b"\0" * ORDER + t for t in texts), np.uint8)
        for low in range(0, len(raw), PIECE):
            begin, high = max(0, low - ORDER), min(len(raw), low + PIECE)
            part = classes[raw[begin:high]]
            inside = marks[(marks >= begin) & (marks < high)]
            part[inside - begin] = 0
            if low == 0:
                part = np.concatenate([np.zeros(ORDER, np.int64), part])
            context = (part[:-3] * size + part[1:-2]) * size + part[2:-1]
            cost = bits[state[context].astype(np.int64) * size + part[ORDER:]]
            owner = np.searchsorted(ends, np.arange(low, high), side="right")
            coded = part[ORDER:] > 0
            first, last = owner[0], owner[-1]
            for i in range(out.shape[1]):
                out[first:last + 1, i] += np.bincount(owner[coded] - first, cost[coded, i], last - first + 1)
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on labelled texts. Rows without an id, text or language teach nothing; no rows, no languages."""
    rows = labelled.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    ids = rows.select("id", "lang").distinct().withColumn("hash", F.xxhash64("id"))
    # One short row for each language.
    sizes = cut_lineage(ids.groupBy("lang").agg(F.count("*").alias("n")))
    known = sorted(r["lang"] for r in sizes.select("lang").collect())
    order = Window.partitionBy("lang").orderBy("hash", "id")
    wider = 2
    while True:
        # Hashes up to a limit that about twice the wanted rows keep, so no task ranks more of a language than those.
        limit = F.least(F.lit(wider * float(sample_rows)) / F.col("n"), F.lit(1.0)) * 2.0**64 - 2.0**63
        near = ids.join(F.broadcast(sizes), "lang").filter(F.col("hash").cast("double") <= limit)
        chosen = cut_lineage(near.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= sample_rows).select("id", "lang"))
        found = chosen.groupBy("lang").agg(F.count("*").alias("m"))
        short = sizes.join(found, "lang", "left").filter(F.coalesce("m", F.lit(0)) < F.least("n", F.lit(sample_rows)))
        if short.isEmpty():
            break
        wider *= 4
    # At most sample_rows * FEW short rows are broadcast. Rows that repeat an id teach once, by their least text.
    texts = rows.join(F.broadcast(chosen) if len(known) <= FEW else chosen, ["id", "lang"])
    sample = texts.groupBy("id", "lang").agg(F.min("text").alias("text"))
    number = {name: i for i, name in enumerate(known)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for text in texts:
                    data = np.concatenate([np.full(ORDER, 256), np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]).astype(np.int64)
                    grams = (data[:-3] << 27) | (data[1:-2] << 18) | (data[2:-1] << 9) | data[3:]
                    gram, n = np.unique(grams, return_counts=True)
                    yield pd.DataFrame({"language": number[lang], "gram": gram, "n": n})

    counts = sample.select("lang", "text").mapInPandas(count, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")).orderBy("language", "gram").toPandas()
    return Model(known, counts["language"].to_numpy(np.int64), counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64))


def with_language(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and bits_per_byte; columns of those names are replaced.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was
    learned. Equal code lengths go to the language that is first by code point. The score is the
    probability of the language among those learned, all being as likely beforehand.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        pred, score, per_byte = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
        at = [i for i, t in enumerate(texts) if t and m.languages and any(map(str.isalpha, t))]
        if at:
            data = [texts.iat[i].encode("utf-8", "replace") for i in at]
            bits = m.bits(data)
            best = bits.argmin(1)
            least = bits[np.arange(len(at)), best]
            score[at] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            per_byte[at] = least / np.array([len(d) for d in data])
            for i, b in zip(at, best):
                pred[i] = m.languages[b]
        return pd.DataFrame({"lang_pred": pred, "score": score, "bits_per_byte": pd.Series(per_byte).astype("Float64")})

    name = "_predicted"
    while name in df.columns:
        name = "_" + name
    out = df.drop("lang_pred", "score", "bits_per_byte").withColumn(name, predict(F.col(text_col)))
    return out.select("*", f"{name}.lang_pred", f"{name}.score", f"{name}.bits_per_byte").drop(name)


def is_language():
    """Whether a row that ``with_language`` has marked is text of some learned language."""
    return (F.col("lang_pred") != UNKNOWN) & F.coalesce(F.col("bits_per_byte") <= MAX_BITS, F.lit(False))


def held_out(id_col: str = "doc_id"):
    """A third of the ids, by their checksum; null ids are not held out and not learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1
