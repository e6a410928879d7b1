"""Exact token counts at every prefix of a text, for a BPE vocabulary of pieces.

Byte-pair merging by score is local: a sequence of pieces is the encoding of its text exactly if
each two neighbours are the encoding of theirs. So the encoding of a prefix is that of a shorter
prefix and one last piece, and a table over all prefixes (last piece, number of tokens) is filled
from left to right: a piece that ends here fits if it and the last piece before it would not be
merged across. ``with_prefix_counts`` stores the number of tokens of every prefix, a byte for each character, and
truncation and budget questions read what is stored: no vocabulary is needed and nothing is encoded again.

No piece holds a word-start mark after another character, nor a Latin letter beside another sign
(both are checked), so a text falls into chunks there, each counted by itself. Tables of chunks are kept, up to a bound, as words come back often;
the table of a text is the running sum over its chunks and the tables within them.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_CHUNK = re.compile(f"{MARK}+(?:[{_LETTERS}]+|[^{MARK}{_LETTERS}]*)|[{_LETTERS}]+|[^{MARK}{_LETTERS}]+")
_BORDER = re.compile(f"[^{MARK}]{MARK}|[{_LETTERS}][^{MARK}{_LETTERS}]|[^{MARK}{_LETTERS}][{_LETTERS}]")
#: Chunks whose tables a worker keeps, the longest kept in characters, and pairs of pieces it keeps.
KEPT, KEPT_LENGTH, KEPT_PAIRS = 600_000, 64, 1_000_000


class PrefixCounter:
    """Prefix tables for one vocabulary file of the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # Control signs and single bytes are never written in a text; all else is a piece with its score.
        ids = [i for i in range(model.get_piece_size()) if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i) or model.IsUnused(i))]
        self.score = {model.id_to_piece(i): model.GetScore(i) for i in ids}
        if any(_BORDER.search(piece) for piece in self.score):
            raise ValueError("a piece crosses the border of two chunks; texts cannot be cut there")
        if model.normalize("ﬁ  ① a ") != f"{MARK}ﬁ{MARK}{MARK}①{MARK}a{MARK}":
            raise ValueError("this vocabulary rewrites texts; only one that keeps them as they are is supported")
        names = ["", *(piece for piece in self.score if self._parts(piece) == [piece])]
        self.names = names
        #: Every ending of a piece: its number if it is a piece, 0 if it is only the end of one.
        self.endings = {piece[i:]: 0 for piece in names[1:] for i in range(len(piece))} | {piece: n for n, piece in enumerate(names) if n}
        self.fits: dict[int, bool] = {}
        self.kept: dict[str, bytes | array] = {}

    def _parts(self, text: str, border: int = -1) -> list[str] | None:
        """Merge the best-scored pair, the leftmost of equals, until none is left; None if that crosses ``border``."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            if border > 0 and sum(map(len, parts[:at + 1])) == border:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, before: int, piece: int) -> bool:
        """Whether two neighbouring pieces stay as they are."""
        left, right = self.names[before], self.names[piece]
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        good = self.fits[before << 20 | piece] = self._parts(left + right, len(left)) is not None
        return good

    def chunks(self, text: str) -> list[str]:
        """The text with marks for blanks and one in front, cut before marks and between letters and other signs."""
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def table(self, chunk: str) -> bytes | array:
        """Number of tokens of each prefix of a chunk, from the empty one on."""
        counts, last = [0], [0]
        endings, fits = self.endings, self.fits
        for end in range(1, len(chunk) + 1):
            for start in range(end - 1, -1, -1):
                piece = endings.get(chunk[start:end])
                if piece is None:
                    start = -1
                    break
                if piece:
                    before = last[start]  # 0: the start, or a character in bytes, which merges with nothing
                    good = fits.get(before << 20 | piece) if before else True
                    if good or good is None and self._fits(before, piece):
                        counts.append(counts[start] + 1)
                        last.append(piece)
                        break
            else:
                start = -1
            if start < 0:  # a character without a piece: one token for each of its bytes
                counts.append(counts[-1] + len(chunk[end - 1].encode("utf-8", "replace")))
                last.append(0)
        return bytes(counts) if counts[-1] < 256 and len(chunk) <= KEPT_LENGTH else array("q", counts)

    def _kept(self, chunk: str) -> bytes | array:
        found = self.kept.get(chunk)
        if found is None:
            found = self.table(chunk)
            if len(chunk) <= KEPT_LENGTH:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[chunk] = found
        return found

    def count(self, text: str | None) -> int:
        kept, total = self.kept, 0
        for chunk in self.chunks(text or ""):
            found = kept.get(chunk)
            total += (self._kept(chunk) if found is None else found)[-1]
        return total

    def prefixes(self, text: str | None) -> tuple[list[int], list[int], list[str]]:
        """Ends of the chunks in characters, tokens up to each end, and the chunks."""
        chunks = self.chunks(text or "")
        ends = [n - 1 for n in accumulate(map(len, chunks))]  # without the mark in front
        return ends, list(accumulate(self._kept(c)[-1] for c in chunks)), chunks

    def steps(self, text: str | None) -> bytes:
        """What each character adds to the number of tokens of the prefix that ends with it, as signed bytes.

        A character adds at most its bytes; one that joins pieces takes away what was joined. Where that is more than
        a byte holds, a text has 16 bits for each character, marked by a first byte of 1 instead of 0.
        """
        parts = [np.zeros(1, np.int64)]
        for chunk in self.chunks(text or ""):
            kept = self._kept(chunk)
            parts.append(np.diff(np.frombuffer(kept, np.uint8 if isinstance(kept, bytes) else np.int64).astype(np.int64)))
        # The mark in front is no character of the text: its token belongs to the first one.
        added = np.concatenate(parts)[1:]
        if len(added) > 1:
            added = np.concatenate([[added[0] + added[1]], added[2:]])
        small = not len(added) or np.abs(added).max() < 128
        return (b"\0" if small else b"\1") + added.astype("<i1" if small else "<i2").tobytes()

    def at(self, table: tuple[list[int], list[int], list[str]], length: int) -> int:
        """Tokens of the first ``length`` characters."""
        ends, counts, chunks = table
        if not ends or length <= 0:
            return 0
        i = bisect_left(ends, min(length, ends[-1]))
        begin = ends[i - 1] if i else -1
        return (counts[i - 1] if i else 0) + self._kept(chunks[i])[min(length, ends[-1]) - begin]

    def longest_prefix(self, table: tuple[list[int], list[int], list[str]], budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        ends, counts, chunks = table
        # A chunk may need more tokens half way than at its end, so look at whole chunks first.
        i = bisect_right(counts, budget)
        best = ends[i - 1] if i else 0
        if i < len(chunks):
            begin = ends[i - 1] if i else -1
            left = budget - (counts[i - 1] if i else 0)
            inside = [n for n, used in enumerate(self._kept(chunks[i])) if used <= left]
            best = max(best, begin + inside[-1], 0)
        return best




def stored_counts(steps: bytes) -> np.ndarray:
    """Number of tokens of each prefix, from the empty one on, out of what ``PrefixCounter.steps`` made."""
    added = np.frombuffer(steps, "<i1" if steps[:1] == b"\0" else "<i2", offset=1)
    return np.concatenate([[0], np.cumsum(added, dtype=np.int64)])


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One per vocabulary in a Python worker. The file must lie at that path on every executor."""
    return PrefixCounter(path)


def with_token_counts(df: DataFrame, path: str, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each whole text; null and empty texts have none.

    A column named ``into`` is replaced. Rows, other columns and repeats stay as they are.
    """
    @F.pandas_udf("long")
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series([counter(path).count(t) for t in texts], dtype="int64")

    return df.withColumn(into, counts(F.col(text_col)))


def with_prefix_table(df: DataFrame, path: str, text_col: str = "text", into: str = "prefix_tokens") -> DataFrame:
    """Adds the table of each text: (end, tokens) for every chunk, ``end`` in characters.

    Within a chunk the counts follow from the chunk's own characters (``PrefixCounter.table``), so
    this is all that must be stored. Null and empty texts have an empty table.
    """
    @F.pandas_udf("array<struct<end:long,tokens:long>>")
    def tables(texts: pd.Series) -> pd.Series:
        found = (counter(path).prefixes(t) for t in texts)
        return pd.Series([[{"end": e, "tokens": n} for e, n in zip(ends, counts)] for ends, counts, _ in found], dtype=object)

    return df.withColumn(into, tables(F.col(text_col)))


def with_prefix_count(df: DataFrame, path: str, length_col: str, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """Adds the tokens of the first ``length_col`` characters; 0 where that is null or below 1."""
    @F.pandas_udf("long")
    def counts(texts: pd.Series, lengths: pd.Series) -> pd.Series:
        c = counter(path)
        return pd.Series([c.at(c.prefixes(t), 0 if pd.isna(n) else int(n)) for t, n in zip(texts, lengths)], dtype="int64")

    return df.withColumn(into, counts(F.col(text_col), F.col(length_col)))


def with_prefix_counts(df: DataFrame, path: str, text_col: str = "text", into: str = "prefix_counts") -> DataFrame:
    """Adds the number of tokens of every prefix of each text, to be written with it: a byte for each character.

    ``count_stored``, ``longest_stored`` and ``truncate_stored`` answer from that column alone. Null and empty texts
    have no characters. A column named ``into`` is replaced.
    """
    @F.pandas_udf("binary")
    def steps(texts: pd.Series) -> pd.Series:
        return pd.Series([counter(path).steps(t) for t in texts], dtype=object)

    return df.withColumn(into, steps(F.col(text_col)))


def count_stored(df: DataFrame, length_col: str | None = None, counts_col: str = "prefix_counts", into: str = "n_tokens") -> DataFrame:
    """Adds the tokens of the first ``length_col`` characters (of all without it) from the stored counts; 0 where the length is
    null or below 1, or the counts are null."""
    @F.pandas_udf("long")
    def counts(steps: pd.Series, lengths: pd.Series) -> pd.Series:
        found = []
        for s, n in zip(steps, lengths):
            upto = stored_counts(s) if s is not None and not pd.isna(n) and n > 0 else [0]
            found.append(int(upto[min(int(n), len(upto) - 1)]) if len(upto) > 1 else 0)
        return pd.Series(found, dtype="int64")

    length = F.col(length_col).cast("long") if length_col else F.lit(2**31 - 1).cast("long")
    return df.withColumn(into, counts(F.col(counts_col), length))


def longest_stored(df: DataFrame, budget: int, counts_col: str = "prefix_counts", into: str = "length") -> DataFrame:
    """Adds the characters of the longest prefix of at most ``budget`` tokens, from the stored counts; 0 for null."""
    @F.pandas_udf("long")
    def longest(steps: pd.Series) -> pd.Series:
        return pd.Series([0 if s is None else int(np.flatnonzero(stored_counts(s) <= budget)[-1]) for s in steps], dtype="int64")

    return df.withColumn(into, longest(F.col(counts_col)))


def truncate_stored(df: DataFrame, budget: int, text_col: str = "text", counts_col: str = "prefix_counts") -> DataFrame:
    """Each text cut to its longest prefix of at most ``budget`` (0 or more) tokens, from the stored counts; null stays null."""
    length = "_longest"
    while length in df.columns:
        length = "_" + length
    measured = longest_stored(df, budget, counts_col, length)
    return measured.withColumn(text_col, F.substring(F.col(text_col), F.lit(1), F.col(length).cast("int"))).drop(length)


def truncate(df: DataFrame, path: str, budget: int, text_col: str = "text") -> DataFrame:
    """Each text cut to its longest prefix of at most ``budget`` tokens; null stays null."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        c = counter(path)
        return pd.Series([None if t is None else t[:c.longest_prefix(c.prefixes(t), budget)] for t in texts], dtype=object)

    return df.withColumn(text_col, cut(F.col(text_col)))
