"""A seeded bijection of ``0 .. n - 1``, worked out number by number.

A Feistel network over pairs of ``a`` and ``b`` values, ``a * b >= n``: each round shifts one half by a
digest of the other, which can be undone, so different numbers stay different. A result that is not below
``n`` is sent through again until one is (at most ``a`` numbers lie outside). No row needs to
see another one, so any number of shuffles costs no sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tunedata.functions.arrays import let
from tunedata.functions.seeded import seeded_key

ROUNDS = 4
#: Times a number may be sent through. Below 256 that is more than lie outside; above, the chance of needing more is below 1e-18.
WALKS = 16


def halves(n: int) -> tuple[int, int]:
    """Sizes of the two halves for numbers below ``n``."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _round(number: int, size: int, seed: Column):
    """The halves change places, and one is shifted by a digest of the other."""
    def shifted(s: Column) -> Column:
        by = F.pmod(seeded_key(number, seed, s["r"]), F.lit(size))
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + by, F.lit(size)).cast("bigint").alias("r"))

    return shifted


def _through(x: Column, a: int, b: int, seed: Column) -> Column:
    left, right = F.pmod(x, F.lit(a)), F.floor(x / F.lit(a)).cast("bigint")
    state = F.struct(left.cast("bigint").alias("l"), right.alias("r"))
    for number in range(1, ROUNDS + 1):
        state = let(state, _round(number, a if number % 2 else b, seed))
    return let(state, lambda s: s["l"] + F.lit(a) * s["r"])


def permuted(x: Column, n: int, seed: Column | int) -> Column:
    """The place of number ``x`` (from 0, below ``n``) in the shuffle with this seed."""
    a, b = halves(n)
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), _through(x.cast("bigint"), a, b, seed),
        lambda place, _: F.when(place < n, place).otherwise(_through(place, a, b, seed)),
    )
    return let(walk, lambda place: F.when(place < n, place).otherwise(F.raise_error(F.lit("no place was found")).cast("bigint")))


def permuted_sql(numbers: str, n: str, seed: str) -> str:
    """CTEs ``feistel`` to ``placed``: (epoch, x, place) of ``numbers`` (epoch, x), in SQL; ``n`` is a scalar query.

    ``seed`` is an expression of ``epoch``.
    """
    key = f"('0x' || substr(md5(((k % {ROUNDS}) + 1) || ':' || {seed} || ':' || r), 1, 15))::BIGINT"
    size = f"CASE WHEN k % 2 = 0 THEN a ELSE b END"
    return f"""
size AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, greatest(1, floor(sqrt(n - 1)) + 1)::BIGINT AS a FROM ({n}) q(n))),
feistel AS (
  SELECT epoch, x, 0 AS k, (x % a)::BIGINT AS l, (x // a)::BIGINT AS r, n, a, b, FALSE AS done FROM ({numbers}), size
  UNION ALL
  SELECT epoch, x, k + 1, r AS l, (l + {key} % ({size})) % ({size}) AS r, n, a, b,
         (k + 1) % {ROUNDS} = 0 AND r + a * ((l + {key} % ({size})) % ({size})) < n
  FROM feistel WHERE NOT done),
placed AS (SELECT epoch, x, l + a * r AS place FROM feistel WHERE done)"""
