"""Mix corpora by probability with a seeded draw per output slot.

Slot ``k`` draws a source independently by probability and takes the next unread row
of that source. The draws come from a digest of seed and slot number, so any slot can
be computed anywhere; how many rows of its source were read before a slot is a running
count, and the rows are attached by an ordinary join.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tunedata.functions.seeded import seeded_unit
from tunedata.operators.indexing import rank_rows, running_sums

# --- fixed values: source names by position in the list -----------------------------
SOURCE_NAMES = ("ft", "harmful", "system")
# ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BlendSpec:
    """Parsed form of comma-separated corpus, probability and start options."""

    names: list[str]
    probs: list[float]
    starts: list[int]


def parse_spec(datasets: str, probabilities: str, start: int | str | None = None) -> BlendSpec:
    names = [n.strip() for n in datasets.split(",")]
    probs = [float(p) for p in str(probabilities).split(",")]
    if start is None:
        starts = [0] * len(names)
    elif isinstance(start, int):
        starts = [start] * len(names)
    else:
        starts = [int(s) for s in start.split(",")]
        if len(starts) == 1:
            starts = starts * len(names)
    if not len(names) == len(probs) == len(starts):
        raise ValueError("corpora, probabilities and starts must have the same length")
    return BlendSpec(names, probs, starts)


def source_name(position: int) -> str:
    return SOURCE_NAMES[min(position, len(SOURCE_NAMES) - 1)]


def take_slice(df: DataFrame, order_col: str, *, start: int = 0, max_count: int | None = None) -> DataFrame:
    """Rows ``start .. start + max_count`` by position; adds the position in the slice.

    Only the order column (unique) is ranked; whole rows move once, or not at all where the
    slice is small enough to be sent to them.
    """
    placed = rank_rows(df.select(order_col), order_col, out="_pos").filter(F.col("_pos") >= start)
    if max_count is not None:
        placed = placed.filter(F.col("_pos") < start + max_count)
    return df.join(placed.withColumn("_pos", F.col("_pos") - start), order_col)


def eval_tail(df: DataFrame, order_col: str, max_count: int) -> DataFrame:
    """Last ``min(0.1 * max_count, 1 % of the rows)`` rows, for data without an eval split."""
    total = df.count()
    return take_slice(df, order_col, start=total - math.floor(min(max_count * 0.1, total * 0.01))).drop("_pos")


def eval_split(splits: dict[str, DataFrame], name: str, order_col: str, max_count: int) -> DataFrame:
    """Evaluation rows: a test split, else validation, else an evaluation corpus, else the tail.

    The first three give their first ``max_count`` rows, or all if there are fewer.
    """
    for split in ("test", "validation"):
        if split in splits:
            return take_slice(splits[split], order_col, max_count=max_count).drop("_pos")
    data = train_split(splits)
    if "eval" in name:
        return take_slice(data, order_col, max_count=max_count).drop("_pos")
    return eval_tail(data, order_col, max_count)


def train_split(splits: dict[str, DataFrame]) -> DataFrame:
    """The training split of a corpus, or all of it if it is not split that way."""
    if "train" in splits:
        return splits["train"]
    parts = list(splits.values())
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tag_sources(sources: list[DataFrame]) -> DataFrame:
    """Bag union with the number of each source, and its name where there are several."""
    tagged = None
    for i, df in enumerate(sources):
        part = df.withColumn("_src", F.lit(i))
        if len(sources) > 1:
            part = part.withColumn("source", F.lit(source_name(i)))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return tagged


def _drawn_source(probs: list[float], unit: Column) -> Column:
    """Source whose cumulative probability interval holds ``unit``."""
    bounds, total = [], 0.0
    for p in probs:
        total += p
        bounds.append(total)
    result = F.lit(len(probs) - 1)
    for i in range(len(probs) - 2, -1, -1):
        result = F.when(unit < bounds[i], F.lit(i)).otherwise(result)
    return result


def _draws(spark: SparkSession, slots: int, probs: list[float], seed: int) -> DataFrame:
    """Slots with their source and how many earlier slots drew the same source."""
    drawn = spark.range(slots).select(
        F.col("id").alias("slot"), _drawn_source(probs, seeded_unit(seed, "id")).alias("_src")
    )
    # Slots are made in order, so the draws of every source are counted along them without a shuffle.
    seen = {f"_n{i}": (F.col("_src") == i).cast("bigint") for i in range(len(probs))}
    counted = running_sums(drawn, "slot", seen, in_order=True)
    return counted.select("slot", "_src", (F.get(F.array(*seen), F.col("_src")) - 1).alias("_rank"))


def _first_guess(sizes: list[int], probs: list[float], stop: str) -> int:
    needed = [n / p for n, p in zip(sizes, probs) if p > 0]
    expected = min(needed) if stop == "first_exhausted" else max(needed)
    return int(expected + 6 * math.sqrt(expected) + 64)


def blend(
    sources: list[DataFrame],
    probs: list[float],
    *,
    order_col: str,
    seed: int = 42,
    max_count: int | None = None,
    start: int | list[int] = 0,
    stop: str = "first_exhausted",
    cap: int | None = None,
) -> DataFrame:
    """Interleave sources by probability; adds ``slot`` and ``source``.

    ``first_exhausted`` stops with the slot that reads the last row of any source,
    ``all_exhausted`` with the slot by which every source was read once (shorter ones
    start over). A source with an empty slice is left out together with its
    probability. ``cap`` keeps the first slots only.
    """
    if len(sources) != len(probs):
        raise ValueError("one probability per source is needed")
    if stop not in ("first_exhausted", "all_exhausted"):
        raise ValueError(f"unknown stopping rule {stop!r}")
    starts = [start] * len(sources) if isinstance(start, int) else list(start)
    tagged = tag_sources(sources)
    # Positions are worked out on the order column alone; whole rows move once, in the last join.
    rows = rank_rows(tagged.select("_src", order_col), order_col, by=["_src"], out="_pos")
    first = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("_src") + 1)
    rows = rows.withColumn("_pos", F.col("_pos") - first).filter(F.col("_pos") >= 0)
    if max_count is not None:
        rows = rows.filter(F.col("_pos") < max_count)

    # One number per source comes back: a list as long as the argument list.
    counts = {r["_src"]: r["count"] for r in tagged.groupBy("_src").count().collect()}
    limit = max_count if max_count is not None else float("inf")
    sizes = [int(max(0, min(counts.get(i, 0) - starts[i], limit))) for i in range(len(sources))]
    live = [i for i, n in enumerate(sizes) if n > 0 and probs[i] > 0]
    if not live:
        return tagged.filter(F.lit(False)).withColumn("slot", F.lit(0).cast("bigint")).drop("_src")
    weight = sum(probs[i] for i in live)
    live_probs = [probs[i] / weight for i in live]
    live_sizes = [sizes[i] for i in live]

    spark = tagged.sparkSession
    slots = _first_guess(live_sizes, live_probs, stop)
    size_of = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in live_sizes]), F.col("_src") + 1)
    while True:
        draws = _draws(spark, slots, live_probs, seed)
        ends = (
            draws.filter(F.col("_rank") == size_of - 1)
            .agg(F.min("slot").alias("first"), F.max("slot").alias("last"), F.count("*").alias("n"))
            .first()
        )
        if stop == "first_exhausted" and ends["n"] > 0:
            end = ends["first"]
            break
        if stop == "all_exhausted" and ends["n"] == len(live):
            end = ends["last"]
            break
        slots *= 2
    if cap is not None:
        end = min(end, cap - 1)
    draws = draws.filter(F.col("slot") <= end)
    original = F.element_at(F.array(*[F.lit(i) for i in live]), F.col("_src") + 1)
    reads = draws.select(
        "slot", original.alias("_d_src"), (F.col("_rank") % size_of).alias("_d_pos")
    )
    return _attach_rows(reads, rows, tagged, order_col)


def _attach_rows(reads: DataFrame, positions: DataFrame, tagged: DataFrame, order_col: str) -> DataFrame:
    """Whole rows of the ``(_d_src, _d_pos)`` read at each slot."""
    wanted = reads.join(
        positions, (F.col("_d_src") == F.col("_src")) & (F.col("_d_pos") == F.col("_pos")), "inner"
    ).drop("_d_src", "_d_pos", "_pos")
    return wanted.join(tagged, ["_src", order_col], "inner").drop("_src")


def blend_spec(
    spec: BlendSpec, read: Callable[[str], dict[str, DataFrame]], *, order_col: str, seed: int = 42,
    max_count: int | None = None, stop: str = "first_exhausted", cap: int | None = None,
) -> DataFrame:
    """Blend the training splits of the corpora that a specification names; ``read`` gives a corpus's splits."""
    sources = [train_split(read(name)) for name in spec.names]
    return blend(sources, spec.probs, order_col=order_col, seed=seed, max_count=max_count, start=spec.starts, stop=stop, cap=cap)


def blend_sweep(
    safe: DataFrame, harmful: DataFrame, ratios: list[float], *, order_col: str, seed: int = 42
) -> DataFrame:
    """The two-source blend for every harmful ratio at once, tagged with ``ratio``."""
    tagged = tag_sources([safe, harmful])
    rows = rank_rows(tagged.select("_src", order_col), order_col, by=["_src"], out="_pos")
    counts = {r["_src"]: r["count"] for r in tagged.groupBy("_src").count().collect()}
    sizes = [counts.get(0, 0), counts.get(1, 0)]
    spark = tagged.sparkSession
    # Every ratio needs about as many slots as exhaust one source; after sum(sizes) one is, whatever the draws.
    slots = min(max(_first_guess(sizes, [1 - r, r], "first_exhausted") for r in ratios), sum(sizes))
    while True:
        # One pass over the slots counts the harmful draws of all ratios; the other draws are the rest.
        drawn = spark.range(slots).select(F.col("id").alias("slot"), seeded_unit(seed, "id").alias("_u"))
        seen = {f"_h{i}": (F.col("_u") >= F.lit(1 - float(r))).cast("bigint") for i, r in enumerate(ratios)}
        counted = running_sums(drawn, "slot", seen, in_order=True)
        full = [
            ((F.col(h) >= sizes[1]) & F.lit(sizes[1] > 0)) | ((F.col("slot") + 1 - F.col(h) >= sizes[0]) & F.lit(sizes[0] > 0))
            for h in seen
        ]
        ends = counted.agg(*[F.min(F.when(f, F.col("slot"))).alias(h) for f, h in zip(full, seen)]).first()
        if None not in ends or slots >= sum(sizes):
            break
        slots = min(2 * slots, sum(sizes))
    if not slots:
        return _attach_rows(spark.createDataFrame([], "ratio double, slot long, _d_src int, _d_pos long"), rows, tagged, order_col)
    reads = F.array(*[F.struct(
        F.lit(float(r)).alias("ratio"), F.lit(ends[h]).cast("bigint").alias("end"), F.col(h).alias("h"),
        (F.col("_u") >= F.lit(1 - float(r))).cast("int").alias("_d_src"),
    ) for r, h in zip(ratios, seen)])
    each = counted.select("slot", F.inline(reads)).filter(F.col("slot") <= F.col("end"))
    position = F.when(F.col("_d_src") == 1, F.col("h")).otherwise(F.col("slot") + 1 - F.col("h")) - 1
    return _attach_rows(each.select("ratio", "slot", "_d_src", position.alias("_d_pos")), rows, tagged, order_col)


def source_census(df: DataFrame, source: str = "source") -> DataFrame:
    """Rows per source and in total (the total is added up from the counts)."""
    return (
        df.groupBy(source)
        .count()
        .rollup(source)
        .agg(F.sum("count").alias("n"), F.grouping(source).alias("_all"))
        .select(
            F.when(F.col("_all") == 1, F.lit("total")).otherwise(F.col(source)).alias("source"), "n"
        )
    )
