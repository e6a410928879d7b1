"""Shingle sets and fast similarity sketches, in NumPy.

The sketch has ``t`` coordinates. In round i every element is placed into one bin and offers it the
value (i, random fraction); a bin keeps the smallest offer, so offers of earlier rounds always win.
In the first ``t`` rounds the bin is drawn by hash; in the next ``t`` rounds all elements meet in
bin i - t, so after 2t rounds at the latest every coordinate is filled. Two sets agree in a
coordinate with the probability of their Jaccard similarity, and the number of agreements is
concentrated as if the coordinates were independent.
"""

from __future__ import annotations

import numpy as np
import xxhash

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z in lower case.

    A text with fewer words than ``width`` has its whole sequence as the only one; no words, none.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, width)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = mixed((total + hashes[i:n - k + 1 + i]) * _WORD[i % len(_WORD)] + _GOLDEN)
    return np.unique(total)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates of a non-empty set, each the low 32 bits of the offer that won."""
    best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    rounds, step, n = 0, max(1, 2 * t // len(elements)), len(elements)
    while rounds < t and (best == np.iinfo(np.uint64).max).any():
        which = np.arange(rounds, min(t, rounds + step), dtype=np.uint64)
        values = mixed(elements[None, :] + (which[:, None] + np.uint64(1)) * _GOLDEN)
        bins = ((values >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        # Earlier rounds win: the round stands above the fraction.
        offers = (which[:, None] << np.uint64(44)) | (mixed(values) >> np.uint64(20))
        np.minimum.at(best, bins.ravel().astype(np.int64), offers.ravel())
        rounds += len(which)
    for i in np.flatnonzero(best == np.iinfo(np.uint64).max):
        shift = np.array([t + i + 1], np.uint64) * _GOLDEN
        best[i] = mixed(elements + shift).min() >> np.uint64(20) | np.uint64(t) << np.uint64(44)
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each ``rows`` neighbouring coordinates, different between bands."""
    grouped = coordinates.astype(np.uint64).reshape(-1, rows)
    key = np.arange(1, len(grouped) + 1, dtype=np.uint64) * _GOLDEN
    for i in range(rows):
        key = mixed(key + grouped[:, i] * _WORD[i % len(_WORD)])
    return key.view(np.int64)


def digest(elements: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit digest of a sorted set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes(), seed=seed)).astype(np.int64))


#: Columns of the bit table that are held at once.
_COLUMNS = 1 << 16


def common(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right`` (or of ``left`` again).

    Every element that occurs in two sets or more is a column of a bit table; rows are intersected
    bit by bit, some columns at a time.
    """
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    other = slice(len(left), None) if right is not None else slice(0, len(left))
    out = np.zeros((len(left), len(right if right is not None else left)), np.int32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        at = column[a:b] - low
        bits = np.zeros((len(sets), (int(at[-1]) >> 6) + 1), np.uint64)
        np.bitwise_or.at(bits, (owner[a:b], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        for i in range(len(left)):
            out[i] += np.bitwise_count(bits[i] & bits[other]).sum(axis=1, dtype=np.int32)
    return out
