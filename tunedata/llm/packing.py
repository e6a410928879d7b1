"""Packing tokenised documents into windows of a fixed size by best fit decreasing.

An overlong document is first cut into full windows; what is left of it, and every shorter document,
is one piece. Pieces are placed by falling length, each into the open window with the least room that
still holds it, or into a new one. Pieces of one length are alike, so the whole corpus is placed from the number
of pieces of each length, at most ``window`` short rows: a segment tree over the remaining capacities
finds the tightest open window, and windows that were filled alike are one range of numbers. That gives a
plan of runs, "from the r-th piece of this length on, q to a window, from window w at offset o", and Spark
gives every piece its rank among those of its length and looks its place up.

The plan is bounded whatever the data: each length opens or splits at most three ranges, and a
window holds at most sqrt(2 * window) different lengths, so there are at most 3 * window * sqrt(2 * window)
runs and some window more (below 400,000 for 2,048; a few thousand in practice).
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tunedata.llm.text import free_name
from tunedata.session import cut_lineage

WINDOW, END_ID = 2048, 1
#: Rows of pieces that are ranked in one task; 2^16 consecutive row numbers.
CHUNK_BITS = 16
#: Blank-separated parts and words whose ids a worker keeps, and the longest kept in characters.
KEPT_PARTS, KEPT_WORDS, KEPT_LENGTH = 600_000, 600_000, 48
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Signs beside which a single blank always begins a token of a byte-level vocabulary.
_SAFE = frozenset(re.findall(f"[!-~{_LETTERS}]", "".join(map(chr, range(0x250)))))
#: Parts made of words, signs that join no letter, and single line breaks; a token ends with each of these.
_SIGNS = r"[!-&(-/:;=-@\[-`{}~]+"
_PLAIN = re.compile(f"[{_LETTERS}]+(?:{_SIGNS})?(?:\n[{_LETTERS}]+(?:{_SIGNS})?)*")
_WORDS = re.compile(f" ?[{_LETTERS}]+|{_SIGNS}|\n")


class PartTokenizer:
    """Ids of whole texts by the tokenizers library, part by part.

    A byte-level vocabulary cuts a text before it merges anything, and always before a single blank between two
    visible signs. So a text is split there, and what comes back often is looked up.
    Files that do more before their merges (normalisers, other cuts) are encoded text by text.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        before = made.get("pre_tokenizer") or {}
        added = [t["content"] for t in made.get("added_tokens", []) if " " in t["content"] or t.get("lstrip") or t.get("rstrip")]
        self.cuts = (
            made.get("normalizer") is None and not added and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
        )
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # How the vocabulary writes the bytes of a blank, a line break, and the letters of words.
        self.model, self.written = self.tokenizer.model, {}
        if self.cuts:
            letters = [c for c in map(chr, range(0x250)) if c in " \n" or c in _SAFE]
            self.written = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = array("I", [token.id for token in self.model.tokenize(word.translate(self.written))]).tobytes()
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        """Ids of a part with the blank before it, kept if it is short; it can be cut off on both sides."""
        if len(part) > KEPT_LENGTH:
            return self._encode(" " + part)
        if _PLAIN.fullmatch(part):
            ids = b"".join(map(self._word, _WORDS.findall(" " + part)))
        else:
            ids = self._encode(" " + part)
        if len(self.kept) >= KEPT_PARTS:
            self.kept.clear()
        self.kept[part] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit numbers; none for null."""
        if not text:
            return b""
        if not self.cuts:
            return self._encode(text)
        parts = text.split(" ")
        found = list(map(self.kept.get, parts))
        sound = parts[0][-1:] in _SAFE
        for i, ids in enumerate(found[1:], 1):
            if ids is None:
                part = parts[i]
                if part and part[0] in _SAFE and part[-1] in _SAFE:
                    found[i] = self._part(part)
                else:
                    sound = False
        if not sound:
            return self._uneven(parts, found)
        found[0] = self._encode(parts[0])
        return b"".join(found)

    def _uneven(self, parts: list[str], found: list[bytes | None]) -> bytes:
        """Ids where some parts are not known or may not be cut off: those are encoded with their neighbours."""
        out: list[bytes] = []
        held, ids = parts[:1], None  # parts that are not cut from each other, and their ids if known
        for part, known in zip(parts[1:], found[1:]):
            if held[-1][-1:] in _SAFE and part[:1] in _SAFE:
                out.append(ids or self._encode(" ".join(held) if not out else " " + " ".join(held)))
                held, ids = [part], known
            else:
                held.append(part)
                ids = None
        out.append(ids or self._encode(" ".join(held) if not out else " " + " ".join(held)))
        return b"".join(out)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PartTokenizer:
    """One per file in a Python worker. The file must lie at that path on every executor."""
    return PartTokenizer(path)


def token_pieces(
    df: DataFrame, path: str, text_col: str = "text", *, window: int = WINDOW, end_id: int | None = END_ID, with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of each text: the row's other columns with the struct ``piece``.

    A document is the ids of its whole text by the file at ``path``, then ``end_id`` (none if that is null).
    It is cut into full windows and one shorter piece: start (ids before it), length, ids_crc32 (of its ids as
    little-endian 32-bit numbers), doc_tokens, and ``ids`` if wanted. Null and empty texts are the
    end id alone, or no piece without one. A column named ``piece`` is replaced; the text is left out.
    """
    kind = "array<struct<start:long,length:long,ids_crc32:long,doc_tokens:long,ids:array<long>>>"
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    @F.pandas_udf(kind)
    def cut(texts: pd.Series) -> pd.Series:
        t, rows = tokenizer(path), []
        for text in texts:
            ids = t.ids(text) + end
            rows.append([{
                "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part), "doc_tokens": len(ids) // 4,
                "ids": np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None,
            } for at in range(0, len(ids), 4 * window) for part in (ids[at:at + 4 * window],)])
        return pd.Series(rows, dtype=object)

    other = [c for c in df.columns if c.lower() not in (text_col.lower(), "piece")]
    pieces = df.select(*other, F.explode(cut(F.col(text_col))).alias("piece"))
    return pieces if with_ids else pieces.withColumn("piece", F.col("piece").dropFields("ids"))


class _OpenWindows:
    """Ranges of windows by remaining capacity, with a segment tree of the capacities that have any."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()  # more leaves than capacities 0..window
        self.some = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _mark(self, room: int, some: bool) -> None:
        at = room + self.size
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def add(self, room: int, first: int, count: int) -> None:
        """Open ``count`` windows from number ``first`` on, with that much room."""
        if count and room:
            if not self.ranges[room]:
                self._mark(room, True)
            self.ranges[room].append((first, count))

    def take(self, room: int) -> tuple[int, int]:
        found = self.ranges[room].pop()
        if not self.ranges[room]:
            self._mark(room, False)
        return found

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least ``length`` that some open window has."""
        at = length + self.size
        if self.some[at]:
            return length
        while at > 1:  # up until a right neighbour has one, then down to its leftmost
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing for ``counts`` pieces of each length: rows (length, rank, first, each, offset).

    From piece number ``rank`` of its length on, ``each`` pieces go to a window one behind the other from
    ``offset`` on, and windows are filled in turn from number ``first`` on. Window numbers are 0, 1, 2, ...
    """
    plan, opened, windows = [], _OpenWindows(window), 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= window:
            raise ValueError(f"a piece of length {length} is in no window of {window}")
        rank, total = 0, counts[length]
        while rank < total:
            room = opened.tightest(length)
            if room is None:
                room, first, count = window, windows, -(-(total - rank) // (window // length))
                windows += count
            else:
                first, count = opened.take(room)
            each, left = room // length, total - rank
            plan.append((length, rank, first, each, window - room))
            full = min(left // each, count)
            opened.add(room - each * length, first, full)
            rank += full * each
            if full < count:
                rest = total - rank  # fewer than ``each``, in the next window
                opened.add(room - rest * length, first + full, 1)
                rank = total
                opened.add(room, first + full + 1, count - full - 1)
    return plan


def pack(pieces: DataFrame, length_col: str = "length", *, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset: the window of each row, and the sum of the lengths before it there.

    Every row is one piece of 1 to ``window`` tokens; rows of null length or none, which need no place, get
    null, and a longer one raises an error. Offsets are without gaps from 0. Rows are told apart by where
    they are written, not by a value, so repeated rows and null ids get places of their own. Columns of the
    two names are replaced. An empty table stays empty.
    """
    row, chunk, rank, n, of_length, of_chunk, earlier = (
        free_name(pieces, name) for name in ("piece_row", "piece_chunk", "piece_rank", "piece_count", "counted_length", "counted_chunk", "counted_before"))
    kept = pieces.drop("sequence_id", "offset")
    size = F.col(length_col)
    written = cut_lineage(kept.withColumn(row, F.monotonically_increasing_id()))
    chunked = written.withColumn(chunk, F.shiftright(F.col(row), CHUNK_BITS))
    placed = chunked.filter(size > 0)
    # One short row for each length and chunk; the windows over them grow with the chunks, not the rows.
    counted = cut_lineage(placed.groupBy(size.cast("long").alias(of_length), F.col(chunk).alias(of_chunk)).agg(F.count("*").alias(n)))
    preceding = Window.partitionBy(of_length).orderBy(of_chunk).rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select(of_length, of_chunk, F.coalesce(F.sum(n).over(preceding), F.lit(0)).alias(earlier))
    # One number for each length; one row more than there may be lengths shows that a piece is too long.
    counts = {r[0]: r[1] for r in counted.groupBy(of_length).agg(F.sum(n)).limit(window + 1).collect()}
    plan = np.array(best_fit_plan(counts, window), np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    starts = np.array([int(length) << 48 | int(first) for length, first in plan[:, :2]], np.int64)

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        n, r = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        found = plan[np.searchsorted(starts, n << 48 | r, "right") - 1] if len(plan) else np.zeros((len(n), 5), np.int64)
        behind = r - found[:, 1]
        return pd.DataFrame({"sequence_id": found[:, 2] + behind // found[:, 3], "offset": found[:, 4] + behind % found[:, 3] * n})

    inside = F.row_number().over(Window.partitionBy(size.cast("long"), chunk).orderBy(row))
    # Ranked rows and counts lie by length and chunk already, so they are merged at every size.
    ranked = placed.withColumn(rank, inside).join(before.hint("merge"), (size.cast("long") == F.col(of_length)) & (F.col(chunk) == F.col(of_chunk)))
    ranked = ranked.withColumn(rank, F.col(rank) - 1 + F.col(earlier)).drop(of_length, of_chunk, earlier)
    located = ranked.withColumn(rank, place(size.cast("long"), F.col(rank)))
    located = located.select(*kept.columns, F.col(rank)["sequence_id"].alias("sequence_id"), F.col(rank)["offset"].alias("offset"))
    without = written.filter(size.isNull() | (size <= 0)).select(*kept.columns, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return located.unionByName(without)


def sequences(packed: DataFrame, *, window: int = WINDOW, pad_id: int = 0, ids_col: str = "ids") -> DataFrame:
    """(sequence_id, ids, n_tokens): the ids of every window in order, padded to ``window`` unless their number is a power of two.

    ``packed``: rows of ``pack`` with their ids; those without a window take no part. A window holds at most ``window`` ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(ids_col).alias("ids"))))
    joined = packed.filter("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    used = F.size("ids")
    even = F.bit_count(used) == 1
    padding = F.array_repeat(F.lit(pad_id).cast("long"), F.when(even, 0).otherwise(F.lit(window) - used))
    return joined.select("sequence_id", F.concat("ids", padding).alias("ids"), used.cast("long").alias("n_tokens"))
