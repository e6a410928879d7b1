"""Periodic stretches of words, caught online by dyadic blocks.

Words are appended one after the other. As soon as a block of 2^k words that starts at a multiple
of 2^k is complete, it gets a catcher: the word appended 2^k + q words after the block's start, for
q from 2^k to 2^(k+1) - 1, completes a suffix of 2^k words that the catcher compares with its block.
So an appended word meets one catcher of each level. Where both agree, the text has period q there;
word-by-word comparison to the left and, as words are appended, to the right gives the maximal stretch.
A stretch of at least twice its period is a square, its squares are one run, and a stretch of three
periods or more holds a whole block of its level before its last period, so none is missed.

Suffixes are compared by fingerprints of sums of powers modulo 2^64, for any number of appended words
at once; what agrees is compared word by word before it counts. Levels go up, and an agreement that lies
within a stretch of a smaller period is a multiple of that period (two periods of a stretch as long as
their sum have a common divisor that is one), so a text of one repeated word costs no more than another.
Work and memory are n log n in the words of a text.
"""

from __future__ import annotations

from fractions import Fraction
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Bytes of text whose words are looked at together; a longer text is looked at alone.
TOGETHER = 4 << 20

_FOUND = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"
)


class _Powers:
    """Powers of an odd number modulo 2^64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            steps = np.full(max(n, 2 * len(self.table)), self.base, np.uint64)
            steps[0] = 1
            self.table = np.cumprod(steps, dtype=np.uint64)
        return self.table


_UP, _DOWN = _Powers(BASE), _Powers(pow(BASE, -1, 1 << 64))


def _mixed(codes: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each code; different codes stay different."""
    x = codes.astype(np.uint64) + np.uint64(BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SquareCatcher:
    """Periodic stretches of a growing sequence of word codes; ``append`` takes any number at a time.

    ``longest`` bounds the stretches that can occur, where that is known: texts with a separate code
    between each two can then be appended together, without levels that none of them can fill.
    """

    def __init__(self, longest: int | None = None):
        self.longest = longest
        self.codes, self.sums, self.n = np.zeros(16, np.int64), np.zeros(17, np.uint64), 0
        self.stretches: list[list[int]] = []  # start, end, period
        self.open: list[int] = []  # those that reach the last word
        self.last: dict[int, int] = {}  # the last one of a period

    def append(self, codes: np.ndarray) -> None:
        before, now = self.n, self.n + len(codes)
        if now > len(self.codes):
            more = max(now, 2 * len(self.codes)) - len(self.codes)
            self.codes = np.concatenate([self.codes, np.zeros(more, np.int64)])
            self.sums = np.concatenate([self.sums, np.zeros(more, np.uint64)])
        self.codes[before:now] = codes
        # sums[i]: of mixed code j times BASE^-j over all j < i.
        terms = _mixed(np.asarray(codes)) * _DOWN.upto(now)[before:now]
        self.sums[before + 1:now + 1] = self.sums[before] + np.cumsum(terms, dtype=np.uint64)
        self.n = now
        # What the new words complete ends among them, so only stretches that did reach them can hold it.
        self.recent, self.open = self.open, []
        for at in self.recent:
            stretch = self.stretches[at]
            stretch[1] = self._right(stretch[1] - stretch[2], stretch[2])
            if stretch[1] == now:
                self.open.append(at)
        size = 1
        while 3 * size <= min(now, self.longest or now):
            self._catch(size, before, now)
            size *= 2

    def _catch(self, size: int, before: int, now: int) -> None:
        """Compare the suffixes of ``size`` words that the words from ``before`` on complete."""
        first = max(before - size + 1, size) // size  # of the blocks in which such suffixes start
        last = (now - size) // size
        if last < first:
            return
        sums, stop = self.sums, (last + 1) * size
        whole = min(stop, now - size + 1)  # starts of complete suffixes
        starts = np.arange(first * size, whole)
        suffix = sums[first * size + size:whole + size] - sums[first * size:whole]
        blocks = np.arange(first - 1, last) * size
        caught = np.repeat(sums[blocks + size] - sums[blocks], size)[:len(starts)]
        powers = np.tile(_UP.upto(2 * size)[size:2 * size], len(blocks))[:len(starts)]
        hits = starts[(suffix * powers == caught) & (starts + size > before)]
        if not len(hits):
            return
        block = (hits // size - 1) * size
        # Inside a stretch of a smaller period, all of which are known by now, there is nothing new.
        known = np.array(sorted((s, e) for s, e, p in (self.stretches[at] for at in self.recent) if p < size))
        if len(known):
            reach = np.maximum.accumulate(known[:, 1])
            at = np.searchsorted(known[:, 0], block, "right") - 1
            new = (at < 0) | (reach[at] < hits + size)
            hits, block = hits[new], block[new]
        order = np.lexsort((block, hits - block))
        for i, j in zip(block[order].tolist(), hits[order].tolist()):
            period = j - i
            before_it = self.stretches[self.last[period]] if period in self.last else (0, 0)
            if before_it[0] <= i and j + size <= before_it[1] or not np.array_equal(self.codes[i:i + size], self.codes[j:j + size]):
                continue
            start, end, at = self._left(i, period), self._right(i + size, period), len(self.stretches)
            self.stretches.append([start, end, period])
            self.recent.append(at)
            self.last[period] = at
            if end == now:
                self.open.append(at)

    def _right(self, at: int, period: int) -> int:
        """End of the stretch of a period, whose words up to ``at`` repeat ``period`` words later."""
        codes, n, step = self.codes, self.n, 8
        while at + period < n:
            stop = min(at + step, n - period)
            differ = np.flatnonzero(codes[at:stop] != codes[at + period:stop + period])
            if len(differ):
                return at + int(differ[0]) + period
            at, step = stop, step * 2
        return n

    def _left(self, at: int, period: int) -> int:
        codes, step = self.codes, 8
        while at > 0:
            low = max(at - step, 0)
            differ = np.flatnonzero(codes[low:at] != codes[low + period:at + period])
            if len(differ):
                return low + int(differ[-1]) + 1
            at, step = low, step * 2
        return 0

    def runs(self, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
        """(start, length, period) of the maximal stretches of at least ``exponent`` (3 or more) smallest periods
        and ``least`` words, by start, then period."""
        if exponent < 3:
            raise ValueError("only stretches of three periods are sure to be caught")
        return sorted({(s, e - s, p) for s, e, p in self.stretches if e - s >= max(least, exponent * p)})


def runs_of(texts: list[np.ndarray], exponent: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several texts, given as word codes that are not negative.

    Texts of about the same length share a catcher, with a code of its own after each.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    kinds = np.frexp(sizes.astype(float))[1]
    for kind in np.unique(kinds[sizes >= max(least, exponent)]).tolist():
        members = np.flatnonzero(kinds == kind)
        catcher = SquareCatcher(longest=int(sizes[members].max()))
        catcher.append(np.concatenate([part for i, m in enumerate(members.tolist()) for part in (texts[m], [-1 - i])]))
        begins = np.concatenate([[0], np.cumsum(sizes[members] + 1)])
        for start, length, period in catcher.runs(exponent, least):
            at = int(np.searchsorted(begins, start, "right")) - 1
            found[members[at]].append((start - int(begins[at]), length, period))
    return found


def _repeated(words: list[bytes], h: int | None) -> list[bytes]:
    """The words with the periodic tail that the number ``h`` asks for, if it ends in 0."""
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + period]
    return words[:a] + (unit * ((n - a) // period + 1))[:n - a]


def _described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        collapsed = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
        start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (start, length, period, 1000 * length // period)
    else:
        collapsed, best = b" ".join(words), (None,) * 4
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()
    return (len(runs), *best, sha256(listed).hexdigest(), collapsed.decode(), sha256(collapsed).hexdigest(),
            [dict(zip(("start", "length", "period"), r)) for r in runs])


def _found(texts: list[str | None], numbers: list[int | None], exponent: int, least: int) -> list[tuple]:
    """What ``periodic_runs`` adds, for texts that are looked at together."""
    # On bytes, split() takes just the six signs of white space that are ASCII.
    words = [_repeated(t.encode("utf-8", "replace").split() if t else [], h) for t, h in zip(texts, numbers)]
    codes = pd.factorize(np.array([w for one in words for w in one] + [None], object)[:-1])[0].astype(np.int64)
    borders = np.cumsum([len(w) for w in words])
    return [_described(w, r) for w, r in zip(words, runs_of(np.split(codes, borders)[:-1], exponent, least))]


def tail_number(id_col: str) -> Column:
    """crc32 of an id in decimal; null for null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def periodic_runs(
    df: DataFrame, text_col: str = "text", *, tail: Column | None = None, exponent: int = 4, least: int = 6, keep_text: bool = True,
) -> DataFrame:
    """Adds the struct ``periodic`` with the runs of words of each whole text.

    Words are separated by ASCII white space. A run is a maximal stretch of at least ``least`` words and
    ``exponent`` (3 or more) times its smallest period. The struct holds n_runs; start (word number from 0),
    length, period and exponent_milli of the run with the greatest length / period (of equals the first,
    then the one of the smallest period; null without a run); the sha256 of all runs as lines
    ``start,length,period``; ``collapsed``, the text without what runs hold after their first period, words
    joined by one blank, and its sha256; and ``runs``, all of them. ``keep_text`` False leaves ``collapsed``
    and ``runs`` null, where only digests are wanted.

    ``tail``: a whole number for each row; where it ends in 0 the text is first given a periodic tail that
    depends on it (see ``_repeated``). Null or absent: texts as they are.

    Null, empty and blank texts have no words and no runs, and an empty ``collapsed``. Each row is looked
    at by itself, so repeated rows, null ids and other columns do not matter; a column named ``periodic``
    is replaced. A text of any length is one task's work, n log n in its words.
    """
    @F.pandas_udf(_FOUND)
    def found(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        together, size = [], 0

        def flush():
            given = [None if n is None or n != n else int(n) for _, n in together]
            for row in _found([t for t, _ in together], given, exponent, least):
                rows.append(row if keep_text else (*row[:6], None, row[7], None))

        for text, number in zip(texts, numbers):
            together.append((text, number))
            size += len(text or "")
            if size >= TOGETHER:
                flush()
                together, size = [], 0
        flush()
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])
        for name in ("start", "length", "period", "exponent_milli"):
            out[name] = out[name].astype("Int64")
        return out

    return df.withColumn("periodic", found(F.col(text_col), F.lit(None).cast("long") if tail is None else tail.cast("long")))
