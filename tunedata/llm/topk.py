"""Exact search for the greatest inner products with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; the vectors of a pivot, sorted by
distance, form annuli of about equal size. For a query q and an annulus of pivot p between the
distances a and b, the triangle inequality says that no vector in it is nearer to q than
max(|q-p| - b, a - |q-p|, 0). With the greatest norm in the annulus that bounds the inner product
from above, as q.x = (|q|^2 + |x|^2 - |q-x|^2) / 2.

A query takes the annuli in the order of their bounds: first the best one, then ever more at a time. After
each round its k-th score so far is what others must reach, and it stops at the first annulus whose bound
falls below. Ties are expanded too, so the answer is exact whatever the pivots.

Scores are exact: matrix products of whole numbers as floats where no sum can reach 2^53, else of
their 22-bit parts, put together modulo 2^64.

Pivots are a bounded sample. Annuli are at most ``RINGS`` per pivot, so their table is small enough
to broadcast at any size of the data; what they hold is dealt out in blocks of ``BLOCK`` vectors,
which queries meet in blocks too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tunedata.session import cut_lineage

PIVOTS, RINGS = 256, 64
#: Vectors an annulus should hold at least, and vectors and queries of one block.
RING_ROWS, BLOCK = 512, 4096
#: How many times as many annuli as before a query takes in each round.
FASTER = 8
#: Bits of the parts whose products are added exactly.
PART = 22


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    """Vectors as rows; a shorter one is padded with zeros."""
    out = np.zeros((len(column), size))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _whole(column: pd.Series, size: int) -> np.ndarray:
    """The same as whole numbers."""
    out = np.zeros((len(column), size), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two matrices of longs, exactly; one beyond a long is an error."""
    close = q.astype(float) @ x.astype(float).T
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * max(q.shape[1], 1)
    if most < 2.0**53:
        return close.astype(np.int64)
    if np.abs(close).max(initial=0) >= 2.0**63 * (1 - 1e-9):
        raise OverflowError("an inner product does not fit a long")
    total = np.zeros(close.shape, np.uint64)
    for i, a in enumerate(_parts(q)):
        for j, b in enumerate(_parts(x)):
            if PART * (i + j) < 64:
                # Sums of products of parts stay below 2^53 over slices of 512 dimensions.
                for low in range(0, q.shape[1], 512):
                    exact = (a[:, low:low + 512] @ b[:, low:low + 512].T).astype(np.int64).astype(np.uint64)
                    total += exact << np.uint64(PART * (i + j))
    return total.astype(np.int64)


def _parts(x: np.ndarray) -> list[np.ndarray]:
    """Parts of ``PART`` bits, the lowest first; only the highest one can be negative."""
    mask = (1 << PART) - 1
    return [(x & mask).astype(float), ((x >> PART) & mask).astype(float), (x >> 2 * PART).astype(float)]


def build_index(vectors: DataFrame, *, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, int]:
    """Index (id, vector): the keyed table (id, vector, pivot, distance, norm2), the pivots, and the dimension.

    The pivots are the vectors with the smallest hash of their id, about one for each 4 * RING_ROWS
    vectors and at most ``pivots``.
    """
    extent = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")).first()
    size = max(extent["size"] or 0, 1)
    count = min(pivots, max(1, math.ceil(extent["n"] / (4 * RING_ROWS))))
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(count).collect()
    centres = _matrix(pd.Series([r["vector"] for r in chosen]), size) if chosen else np.zeros((1, size))
    norms = (centres ** 2).sum(1)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["vector"], size)
            own = (x ** 2).sum(1)
            square = np.maximum(own[:, None] + norms - 2 * x @ centres.T, 0)
            nearest = square.argmin(1)
            yield batch.assign(pivot=nearest, distance=np.sqrt(square[np.arange(len(x)), nearest]), norm2=own)

    keyed = vectors.select("id", "vector").mapInPandas(key, "id long, vector array<long>, pivot int, distance double, norm2 double")
    return cut_lineage(keyed), centres, size


def annuli(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keyed table with ring and block, and (pivot, ring, near, far, norm2, blocks) of every annulus."""
    cells = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", F.array(*(F.lit(i / RINGS) for i in range(1, RINGS))), 1000).alias("cuts"))
    rings = F.greatest(F.least(F.floor(F.col("n") / RING_ROWS), F.lit(RINGS)), F.lit(1))
    kept = F.filter("cuts", lambda c, i: F.floor((i + 1) * rings / RINGS) > F.floor(i * rings / RINGS))
    bounds = cells.select("pivot", kept.alias("cuts"))  # one short row for each pivot
    ringed = keyed.join(F.broadcast(bounds), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("distance")))).drop("cuts")
    table = ringed.groupBy("pivot", "ring").agg(
        F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("norm2").alias("norm2"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    table = cut_lineage(table)
    placed = ringed.drop("norm2").join(F.broadcast(table.select("pivot", "ring", "blocks")), ["pivot", "ring"])
    return placed.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks"), table


def _score(size: int, k: int):
    def best(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        """The k best of a block for each query of a block."""
        out = {"query_id": [], "id": [], "score": []}
        if len(queries) and len(block):
            block = block.sort_values("id", kind="stable")
            ids, x = block["id"].to_numpy(), _whole(block["vector"], size)
            for low in range(0, len(queries), 512):
                part = queries.iloc[low:low + 512]
                scores = products(_whole(part["query"], size), x)
                for q, row in zip(part["query_id"].to_numpy(), scores):
                    usable = np.flatnonzero(ids != q)
                    if len(usable) > k:
                        least = np.partition(row[usable], len(usable) - k)[len(usable) - k]
                        above, level = usable[row[usable] > least], usable[row[usable] == least]
                        usable = np.concatenate([above, level[:k - len(above)]])  # level is in the order of ids
                    out["query_id"] += [q] * len(usable)
                    out["id"] += ids[usable].tolist()
                    out["score"] += row[usable].tolist()
        return pd.DataFrame(out).astype("int64")

    return best


def _search(asked: DataFrame, placed: DataFrame, size: int, k: int) -> DataFrame:
    """(query_id, id, score) of the k best in each block asked for; ``asked``: (query_id, query, pivot, ring, block)."""
    keys = ["pivot", "ring", "block", "part"]
    spread = asked.withColumn("hash", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)))
    loads = spread.groupBy("pivot", "ring", "block").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    queries = spread.join(loads, ["pivot", "ring", "block"]).withColumn("part", F.pmod("hash", "parts")).drop("hash", "parts")
    blocks = placed.join(loads, ["pivot", "ring", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("id", "vector", *keys)
    return queries.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(_score(size, k), "query_id long, id long, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, id, score): the k greatest inner products of every query, ties to the smaller id.

    ``vectors`` and ``queries``: (id, vector) of longs; a score beyond a long is an error. A vector is no
    answer to the query of the same id, however often the id occurs; of queries that repeat an id, one
    is asked. Of repeated rows of an answer each counts. Null ids and vectors take no part; a shorter
    vector counts as padded with zeros. With fewer than k candidates all are returned; no vectors or
    no queries give no rows.
    """
    usable = vectors.filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    asking = queries.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).dropDuplicates(["id"])
    keyed, centres, size = build_index(usable, pivots=pivots)
    placed, table = annuli(keyed)
    placed = cut_lineage(placed)
    rings = table.orderBy("pivot", "ring").toPandas()  # at most PIVOTS * RINGS short rows
    norms = (centres ** 2).sum(1)
    pivot, near, far, most, blocks = (rings[c].to_numpy() for c in ("pivot", "near", "far", "norm2", "blocks"))

    def bounds(q: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of some queries in every annulus, above all rounding."""
        own = (q ** 2).sum(1)[:, None]
        to_pivot = np.sqrt(np.maximum(own + norms - 2 * q @ centres.T, 0))[:, pivot]
        slack = 1e-6 * (1 + to_pivot + np.sqrt(own) + np.sqrt(most))
        miss = np.maximum(np.maximum(to_pivot - far, near - to_pivot) - slack, 0)
        return (own + most - miss ** 2) / 2 + 1e-9 * (own + most)

    def expand(begin: int, end: int):
        def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The blocks of the annuli number ``begin`` to ``end`` by falling bound, as far as that reaches ``least``."""
            for batch in batches:
                for low in range(0, len(batch), 256):
                    part = batch.iloc[low:low + 256]
                    upper = bounds(_matrix(part["query"], size))
                    order = np.argsort(-upper, axis=1, kind="stable")[:, begin:end]
                    reach = np.take_along_axis(upper, order, 1) >= part["least"].to_numpy()[:, None]
                    row, at = np.nonzero(reach)
                    ring = order[row, at]
                    block = np.concatenate([np.arange(n) for n in blocks[ring]]) if len(ring) else []
                    row, ring = np.repeat(row, blocks[ring]), np.repeat(ring, blocks[ring])
                    yield part.iloc[row][["query_id", "query"]].assign(pivot=pivot[ring], ring=rings["ring"].to_numpy()[ring], block=block)

        return asked

    kind = "query_id long, query array<long>, pivot int, ring int, block long"
    wanted = cut_lineage(asking.select(F.col("id").alias("query_id"), F.col("vector").alias("query")))
    best = wanted.select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).limit(0)
    begin, step = 0, 1
    while begin < len(rings):
        # A query with fewer than k answers so far has no limit yet.
        reached = best.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k).drop("n")
        limited = wanted.join(reached, "query_id", "left").withColumn("least", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))))
        asked = cut_lineage(limited.mapInPandas(expand(begin, begin + step), kind))
        if asked.isEmpty():
            break  # what comes later has lower bounds still
        best = cut_lineage(_merged(best.unionByName(_search(asked, placed, size, k)), k).drop("rank"))
        begin, step = begin + step, step * FASTER
    return _merged(best, k).select("query_id", F.col("rank").cast("int"), "id", "score")


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, vector) with floor(scale * x) for each component; vectors that are null or hold null, NaN or infinity are left out."""
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.filter(F.col(vector_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), whole.alias("vector"))


def top_k_sql(embeddings: str) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM {embeddings}
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
