"""Reproducible pseudo-random columns, a pure function of a seed and the row's keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KEY_BITS = 60


def _digest(seed, cols) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def seeded_key(seed, *cols) -> Column:
    """Uniform integer in ``[0, 2**60)``; the sort key of every seeded shuffle."""
    return F.conv(F.substring(_digest(seed, cols), 1, 15), 16, 10).cast("bigint")


def seeded_unit(seed, *cols) -> Column:
    """Uniform double in ``[0, 1)``."""
    return F.conv(F.substring(_digest(seed, cols), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def seeded_choice(options: list[str], seed, *cols) -> Column:
    """One of ``options``, uniformly."""
    index = F.floor(seeded_unit(seed, *cols) * len(options)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(o) for o in options]), index)
