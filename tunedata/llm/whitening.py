"""Whitening of vectors by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed: it is known by its products with a block of directions, each one pass
of the data, in which every task centres its rows and multiplies twice, and the blocks of all tasks are
added in two levels. Around that, on the driver, only matrices of the dimension times the subspace:

- Rayleigh-Ritz on the subspace gives the pairs nearest to the wanted ones and their residuals;
- for every wanted pair that is not done, the correction equation, projected off the pairs found so far
  and the present ones, is solved by some steps of MINRES, all pairs in step, so one pass serves them all;
- corrections join the subspace, which starts again from its best vectors when it gets too large;
- a leading pair whose residual is down to rounding is locked: the rest is kept orthogonal to it.

Components are whole numbers, so sums are exact, and a row is centred exactly, as n * x - sum, before
anything is rounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tunedata.session import cut_lineage

#: Scale and offset that turn a component into a whole number.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Vectors beyond the wanted ones that a subspace starts with, and most steps of MINRES for one correction.
GUARD, INNER = 8, 6
#: Rows that are multiplied together within a task, groups of tasks whose results are added, and cells of one row of a result.
ROWS, FAN, CELLS = 2048, 64, 8192
#: Rounds of corrections before giving up.
ROUNDS = 200


def whole_vectors(df: DataFrame, vector_col: str, *, scale: int = SCALE, offset: int = OFFSET, into: str = "whole") -> DataFrame:
    """Rows whose vector is sound, with floor(scale * x) + offset of each component as longs in ``into``.

    Vectors that are null or hold null, NaN or infinity are left out. A column named ``into`` is replaced.
    """
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long") + offset)
    return df.filter(F.col(vector_col).isNotNull() & sound).withColumn(into, whole)


@dataclass(frozen=True)
class Moments:
    """Number of vectors and the exact sum of each component."""

    n: int
    sums: tuple[int, ...]
    offset: int = OFFSET

    @property
    def size(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - mean, from whole numbers; exact up to the last division."""
        return self.scaled(x) / self.n

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly; the offset, which cancels, is taken out first."""
        x = x - self.offset
        sums = [s - self.n * self.offset for s in self.sums]
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, sums), default=0))
        kind = np.int64 if most < 2**62 else object
        return self.n * x.astype(kind) - np.array(sums, kind)


def _rows(column: pa.Array, size: int, fill: int) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones are filled up."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return flat.reshape(len(lengths), size)
    out = np.full((len(lengths), size), fill, np.int64)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def _summed(vectors: DataFrame, matrix: Callable[[np.ndarray], np.ndarray], size: int, fill: int) -> np.ndarray | None:
    """The sum of ``matrix`` (floats or longs) over blocks of rows of (whole), flat; None without rows.

    Each task adds up its own blocks. Results travel in pieces of ``CELLS``, and the tasks are added in ``FAN``
    groups, so no task holds more than its group's pieces, nor the driver more than ``FAN`` results.
    """
    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            x = _rows(batch.column(0), size, fill)
            for low in range(0, len(x), ROWS):
                found = matrix(x[low:low + ROWS]).ravel()
                total = found if total is None else total + found
        if total is not None:
            pieces = [total[low:low + CELLS].tobytes() for low in range(0, len(total), CELLS)]
            group = TaskContext.get().partitionId() % FAN
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([group] * len(pieces), pa.int32()), "piece": pa.array(range(len(pieces)), pa.int32()),
                "kind": [total.dtype.str] * len(pieces), "cells": pieces})

    def add(rows: pd.DataFrame) -> np.ndarray:
        return np.sum([np.frombuffer(c, k) for c, k in zip(rows["cells"], rows["kind"])], axis=0)

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.head(1)[["piece", "kind"]].assign(cells=[add(rows).tobytes()])

    found = vectors.select("whole").mapInArrow(within, "part int, piece int, kind string, cells binary")
    rows = found.groupBy("part", "piece").applyInPandas(across, "piece int, kind string, cells binary").toPandas()
    return np.concatenate([add(group) for _, group in rows.groupby("piece", sort=True)]) if len(rows) else None


def moments(vectors: DataFrame, *, offset: int = OFFSET) -> Moments:
    """Number and exact sums of (whole); components that a shorter vector lacks count as ``offset``."""
    size = vectors.agg(F.max(F.size("whole"))).first()[0] or 0

    def halves(x: np.ndarray) -> np.ndarray:
        """Upper and lower 32 bits are added apart, which no number of rows overflows in practice."""
        return np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

    found = _summed(vectors, halves, size, offset)
    if found is None:
        return Moments(0, (0,) * size, offset)
    n, *cells = found.tolist()
    return Moments(n, tuple((high << 32) + low for high, low in zip(cells[:size], cells[size:])), offset)


def covariance_product(vectors: DataFrame, seen: Moments) -> Callable[[np.ndarray], np.ndarray]:
    """U -> V U for the covariance V (divisor n) of (whole), one pass of the data for a block U of directions."""
    def product(u: np.ndarray) -> np.ndarray:
        def matrix(x: np.ndarray) -> np.ndarray:
            c = seen.centred(x).astype(float)
            return c.T @ (c @ u) / seen.n

        found = _summed(vectors, matrix, seen.size, seen.offset)
        return np.zeros(u.shape) if found is None else found.reshape(u.shape)

    return product


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Directions of ``new`` that are not in the (orthonormal) bases, orthonormal; dependent ones are left out."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(3):  # once more than twice is enough, as nearly dependent ones are scaled up in between
        for basis in bases:
            new = new - basis @ (basis.T @ new)
        if not new.shape[1]:
            return new
        left, strength, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, strength > 1e-10]
    return new


def _corrections(product, values: np.ndarray, residuals: np.ndarray, found: np.ndarray, steps: int) -> np.ndarray:
    """Some steps of MINRES, all columns in step, for (I - QQ')(V - value)(I - QQ') t = -residual with Q = ``found``."""
    def off(x):
        return x - found @ (found.T @ x)

    def norm(x):
        return np.linalg.norm(x, axis=0)

    v_old = np.zeros_like(residuals)
    v = off(-residuals)
    beta = norm(v)
    safe = np.where(beta > 0, beta, 1)
    v = v / safe
    eta, t = beta.copy(), np.zeros_like(v)
    w_old, w = np.zeros_like(v), np.zeros_like(v)
    c_old, c, s_old, s = (np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta))
    beta_now, alive, begun = np.zeros_like(beta), beta > 0, beta.copy()
    for _ in range(steps):
        if not alive.any():
            break
        av = np.zeros_like(v)
        av[:, alive] = product(v[:, alive])
        av = off(av - values * v)
        alpha = (v * av).sum(0)
        v_new = off(av - alpha * v - beta_now * v_old)
        beta_new = norm(v_new)
        # Two rotations bring the new column of the tridiagonal matrix to a triangle.
        d = c * alpha - c_old * s * beta_now
        r1 = np.hypot(d, beta_new)
        r2 = s * alpha + c_old * c * beta_now
        r3 = s_old * beta_now
        ok = alive & (r1 > 0)
        r1 = np.where(ok, r1, 1)
        c_new, s_new = d / r1, beta_new / r1
        w_new = (v - r3 * w_old - r2 * w) / r1
        t = t + np.where(ok, c_new * eta, 0) * w_new
        eta = np.where(ok, -s_new * eta, eta)
        # A thousandth of the residual is more than one round of Rayleigh-Ritz makes use of.
        alive = ok & (np.abs(eta) > 1e-3 * begun) & (beta_new > 1e-14 * np.abs(values).max(initial=0))
        v_old, v = v, v_new / np.where(beta_new > 0, beta_new, 1)
        w_old, w, c_old, c, s_old, s, beta_now = w, w_new, c, c_new, s, s_new, beta_new
    return t


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, *, seed: int = 7, inner: int = INNER, largest: int | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` greatest eigenvalues of a symmetric operator, falling, unit eigenvectors as columns, and the products made.

    ``product`` takes a block of columns. A pair is done when its residual is below size * 2^-52 of the
    greatest eigenvalue, or, where the rounding of the products themselves is coarser, when it has stopped
    falling below 2^-40 of it; if neither comes about an error is raised. ``largest``: most vectors of the subspace.
    """
    wanted = min(wanted, size)
    keep = min(wanted + GUARD, size)
    largest = min(size, max(largest or 3 * keep, keep + 1))
    q = _orthonormal(np.random.default_rng(seed).standard_normal((size, keep)))
    vq, passes = product(q), 1
    locked, locked_values = np.zeros((size, 0)), np.zeros(0)
    best, stalled = np.inf, 0
    for _ in range(ROUNDS):
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn  # Ritz vectors themselves, the best first
        residuals = vq - q * values
        off = residuals - locked @ (locked.T @ residuals)
        size_of = np.linalg.norm(off, axis=0)
        scale = max(np.abs(values).max(initial=0), np.abs(locked_values).max(initial=0))
        goal = size * 2.0**-52 * scale
        front = size_of[:max(wanted - len(locked_values), 1)]
        worst = front.max(initial=0)
        stalled = stalled + 1 if worst > best / 2 else 0
        best = min(best, worst)
        whole = q.shape[1] + locked.shape[1] == size
        if worst > goal and (whole or stalled >= 3) and worst <= 2.0**-40 * scale:
            goal = worst  # as good as the products are
        bad = np.flatnonzero(size_of > goal)
        done = int(bad[0]) if len(bad) else len(size_of)
        # Lock from the front, and go on while a vector left over is greater than one that is locked.
        take = 0
        while take < done and (len(locked_values) + take < wanted or values[take] > np.sort(np.append(locked_values, values[:take]))[-wanted]):
            take += 1
        if take:
            locked, locked_values = np.hstack([locked, q[:, :take]]), np.append(locked_values, values[:take])
            q, vq, values, off = q[:, take:], vq[:, take:], values[take:], off[:, take:]
            best, stalled = np.inf, 0
        complete = len(locked_values) >= wanted and (not len(values) or values[0] <= np.sort(locked_values)[-wanted] + goal)
        if complete or not q.shape[1]:
            order = np.argsort(-locked_values, kind="stable")[:wanted]
            return locked_values[order], locked[:, order], passes
        if take and len(locked_values) < wanted and not whole:
            continue  # residuals of the rest change with what is locked
        front = max(wanted - len(locked_values), 1)
        steps = min(inner, size - locked.shape[1] - min(front, q.shape[1]))
        t = np.zeros((size, 0))
        if steps > 0 and not whole:
            present = np.hstack([locked, q[:, :front]])
            before = passes

            def counted(u):
                nonlocal passes
                passes += 1
                return product(u)

            t = _corrections(counted, values[:front], off[:, :front], present, steps)
            assert passes - before <= steps
        if q.shape[1] + t.shape[1] > largest - locked.shape[1]:  # start again from the best
            q, vq = q[:, :keep], vq[:, :keep]
        t = _orthonormal(t, locked, q)
        if t.shape[1]:
            q, vq = np.hstack([q, t]), np.hstack([vq, product(t)])
            passes += 1
    raise ArithmeticError(f"{len(locked_values)} of {wanted} eigenvectors were found in {ROUNDS} rounds")


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learned: moments, eigenvalues (falling), eigenvectors (columns), the trace, and checks."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int


def fit(vectors: DataFrame, components: int = COMPONENTS, *, offset: int = OFFSET) -> Whitening:
    """Learn from all rows of (whole), which should be a written table, as it is read once for each product.

    Directions in which the vectors do not differ (eigenvalue not above size * 2^-52 of the trace) have no
    whitening and are left out, so there may be fewer components, or none.
    """
    seen = moments(vectors, offset=offset)
    if not seen.n or not seen.size:
        return Whitening(seen, np.zeros(0), np.zeros((seen.size, 0)), 0.0, 0.0, 0)
    trace = float(_summed(vectors, lambda x: np.array([(seen.centred(x).astype(float) ** 2).sum() / seen.n]), seen.size, offset)[0])
    if not trace:
        return Whitening(seen, np.zeros(0), np.zeros((seen.size, 0)), 0.0, 0.0, 0)
    values, found, passes = jacobi_davidson(covariance_product(vectors, seen), seen.size, components)
    real = values > seen.size * 2.0**-52 * trace
    values, found = values[real], found[:, real]
    scaled = found / np.sqrt(values)

    def outer(x: np.ndarray) -> np.ndarray:
        w = seen.centred(x).astype(float) @ scaled  # centred: the exact sum of the centred rows is 0
        return w.T @ w / seen.n

    error = np.abs(_summed(vectors, outer, seen.size, offset).reshape(len(values), -1) - np.eye(len(values))).max(initial=0)
    return Whitening(seen, values, found, trace, float(error), passes)


def whiten(df: DataFrame, vector_col: str, components: int = COMPONENTS, *, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Adds the struct ``whitened``: n, deviation, values, explained, identity_error.

    Every component c becomes x = floor(scale * c) + offset; rows whose vector is null or holds null, NaN or
    infinity are left out, and all others are learned from, repeated rows each time. ``values`` are the
    projections of x - mean on the first components (unit eigenvectors of the covariance, by falling
    eigenvalue) over the roots of their eigenvalues; ``explained`` is each eigenvalue's share of the
    trace; ``deviation`` is the sum over all dimensions of (n * x - sum)^2, exact (an error where it
    exceeds a long); ``identity_error`` is the largest entry of the whitened rows' covariance less the identity.

    A vector that is shorter than others counts as if it held 0 beyond its end. Directions without spread
    are no components: there are fewer, none for equal vectors or a single one. An empty table stays empty. Ids
    and other columns take no part; a column named ``whitened`` is replaced.
    """
    kept = df.drop("whitened")
    names = kept.columns
    # Vectors beside the whole row, so no other column can clash.
    packed = cut_lineage(whole_vectors(kept.select(F.struct(*names).alias("row"), F.col(vector_col).alias("vector")), "vector", scale=scale, offset=offset).select("row", "whole"))
    model = fit(packed.select("whole"), components, offset=offset)
    seen, scaled = model.moments, model.vectors / np.sqrt(model.values)
    explained = [float(e) / model.trace for e in model.values]

    @F.pandas_udf("deviation long, values array<double>")
    def described(column: pd.Series) -> pd.DataFrame:
        x = np.full((len(column), seen.size), offset, np.int64)
        for row, v in zip(x, column):
            row[:len(v)] = v
        apart = seen.scaled(x)
        if apart.dtype != object and float(np.abs(apart).max(initial=0)) ** 2 * seen.size >= 2.0**62:
            apart = apart.astype(object)
        values = apart.astype(float) / seen.n @ scaled
        return pd.DataFrame({"deviation": (apart ** 2).sum(1).astype(np.int64), "values": list(values)})

    result = F.struct(
        F.lit(seen.n).cast("long").alias("n"), "described.deviation", "described.values",
        F.array(*[F.lit(e) for e in explained]).cast("array<double>").alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
    return packed.withColumn("described", described("whole")).select("row", result.alias("whitened")).select("row.*", "whitened")
