"""Positions, ranks and running sums that stay parallel on hot groups.

A window over the whole table, or over a group that holds a third of it, runs in one task. Rows are
shuffled once here, in one of two ways. Groups that a task can hold lie together and are summed by a plain
window. The whole table, and groups of more than ``RANGE_ROWS`` rows, are cut into ranges of (group, key,
tie), so any of them may lie over many tasks: each task adds up its own rows in that order and writes them; only the
group it begins with can have rows in earlier ranges, so one short row for each range carries the totals
on. Ranges come from Spark's own sampling of the order columns, so keys may be of any type that has an
order, and a value that repeats without end is cut by its ties.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tunedata.functions.seeded import seeded_key
from tunedata.session import cut_lineage

#: Rows of a group that one task may hold.
RANGE_ROWS = 250_000
#: Ranges to shuffle into; None for ``spark.sql.shuffle.partitions``, which Spark coalesces where they are small.
RANGES: int | None = None


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; null equals null and NaN equals NaN."""
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([a != b for a, b in zip(values, values[1:])], bool)
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    # A comparison with a null is null: no difference if both are.
    either = pc.xor(now.is_null(), before.is_null())
    found = pc.if_else(pc.is_null(pc.not_equal(now, before)), either, pc.not_equal(now, before)).to_numpy(zero_copy_only=False).copy()
    if pa.types.is_floating(column.type):
        nan = pc.and_(pc.fill_null(pc.is_nan(now), False), pc.fill_null(pc.is_nan(before), False))
        found &= ~nan.to_numpy(zero_copy_only=False)
    return found


def _added_up(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each of ``starts`` (positions of first rows, the first one 0)."""
    if values.dtype.kind == "i":
        total = np.cumsum(values)
        return total - np.repeat(total[starts] - values[starts], np.diff(np.append(starts, len(values))))
    # Sums of floats may not pass through those of other groups, so partial sums are doubled within a group.
    inside = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    total, step = values.copy(), 1
    while step <= inside.max(initial=0):
        total[step:] += np.where(inside[step:] >= step, total[:-step], 0.0)
        step *= 2
    return total


def _local_sums(by: list[str], names: list[str], passed: list[str]):
    """Adds to ordered rows: the sums within the task, whether a row is of the task's first group, and of its first or last row."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        group, carried, at_first, held = None, [0] * len(names), True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(batch.schema.get_field_index(b)) for b in by]
            change = np.zeros(n, bool)
            for column in keys:
                change[1:] |= _differs(column)
            begins = group is None
            if not begins:  # the row before this batch
                change[0] = any(_differs(pa.concat_arrays([old, column.slice(0, 1)]))[0] for old, column in zip(group, keys))
                at_first = at_first and not change[0]
            starts = np.flatnonzero(change)
            starts = starts if len(starts) and starts[0] == 0 else np.append(0, starts)
            first = np.zeros(n, bool)
            if at_first:
                stop = int(starts[1]) if len(starts) > 1 else n
                first[:stop] = True
                at_first = len(starts) == 1
            sums = []
            for i, name in enumerate(names):
                column = batch.column(batch.schema.get_field_index(f"_v_{name}"))
                values = column.to_numpy(zero_copy_only=False)
                total = _added_up(values, starts)
                if not begins and not change[0]:
                    total[:starts[1] if len(starts) > 1 else n] += carried[i]
                carried[i] = total[-1]
                sums.append(pa.array(total))
            group = [column.slice(n - 1, 1) for column in keys]
            if held is not None:
                yield held
            edge = np.zeros(n, bool)
            ends = [edge.copy(), edge]
            ends[0][0] = begins
            held = pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in passed] + sums
                + [pa.array(first), pa.array(ends[0]), pa.array(ends[1]), pa.array(np.full(n, part, np.int32))],
                names=[*passed, *(f"_l_{name}" for name in names), "_head", "_first", "_last", "_range"],
            )
        if held is not None:
            last = np.zeros(held.num_rows, bool)
            last[-1] = True
            yield held.set_column(held.schema.get_field_index("_last"), "_last", pa.array(last))

    return add


def running_sums(
    df: DataFrame,
    key: str,
    sums: dict[str, Column],
    *,
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    ranges: int | None = None,
    in_order: bool = False,
) -> DataFrame:
    """Add inclusive running sums in ``(key, *tie)`` order, per group of ``by``.

    ``(key, *tie)`` orders the rows of a group totally. Whole numbers are summed as longs, others as doubles;
    a null adds nothing. No task holds more than ``RANGE_ROWS`` rows of a group, or a range. The rows pass
    the shuffle with all their columns, and those of hot groups or without groups are written, so
    rank keys alone and join long texts afterwards. ``df`` is read twice, once for its groups or order columns only.
    ``in_order`` leaves the shuffle out where the partitions already are such ranges, as those of ``spark.range``.
    """
    by, tie, names = list(by), list(tie), list(sums)
    for c in (*by, key, *tie):
        if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"no order for {df.schema[c].dataType.simpleString()}")
    whole = {name: isinstance(df.select(value).schema[0].dataType, T.IntegralType) for name, value in sums.items()}
    values = [F.coalesce(value.cast("bigint" if whole[n] else "double"), F.lit(0)).alias(f"_v_{n}") for n, value in sums.items()]
    kept = [c for c in df.columns if c not in names]
    placed = df.select("*", *values)
    if not by or in_order:
        return _over_ranges(placed, kept, by, key, tie, whole, ranges, in_order)
    hot = cut_lineage(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > RANGE_ROWS).drop("_n"))
    if hot.isEmpty():
        return _within_groups(placed, kept, by, key, tie, names)
    # At most one key for each RANGE_ROWS rows is hot.
    hot = hot.select(*[F.col(c).alias(f"_hot_{c}") for c in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in by])
    large = _over_ranges(placed.join(hot, same, "left_semi"), kept, by, key, tie, whole, ranges, False)
    return _within_groups(placed.join(hot, same, "left_anti"), kept, by, key, tie, names).unionByName(large)


def _within_groups(placed: DataFrame, kept: list[str], by: list[str], key: str, tie: list[str], names: list[str]) -> DataFrame:
    """Running sums of groups that a task can hold: one shuffle by the group."""
    window = Window.partitionBy(*by).orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(*kept, *[F.sum(f"_v_{n}").over(window).alias(n) for n in names])


def _in_ranges(placed: DataFrame, order: list[str], ranges: int | None) -> DataFrame:
    ranges = ranges or RANGES
    placed = placed.repartitionByRange(ranges, *order) if ranges else placed.repartitionByRange(*order)
    return placed.sortWithinPartitions(*order)


def _over_ranges(
    placed: DataFrame, kept: list[str], by: list[str], key: str, tie: list[str], whole: dict[str, bool], ranges: int | None, in_order: bool,
) -> DataFrame:
    """Running sums over ranges of (group, key, tie): sums within each, and the totals of earlier ones."""
    names = list(whole)
    ordered = placed if in_order else _in_ranges(placed, [*by, key, *tie], ranges)
    kind = {n: T.LongType() if whole[n] else T.DoubleType() for n in names}
    flags = [T.StructField(c, T.BooleanType()) for c in ("_head", "_first", "_last")]
    added = [T.StructField(f"_l_{n}", kind[n]) for n in names]
    schema = T.StructType([*[placed.schema[c] for c in kept], *added, *flags, T.StructField("_range", T.IntegerType())])
    local = cut_lineage(ordered.mapInArrow(_local_sums(by, names, kept), schema))
    # What the last groups of earlier ranges hold of the group a range begins with: two short rows a range.
    ends = local.filter("_last").select(*by, "_range", F.lit(1).alias("_end"), *[F.col(f"_l_{n}") for n in names])
    starts = local.filter("_first").select(*by, "_range", F.lit(0).alias("_end"), *[F.lit(0).cast(kind[n]).alias(f"_l_{n}") for n in names])
    earlier = Window.partitionBy(*by).orderBy("_range", "_end").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(starts).select("_range", "_end", *[F.sum(f"_l_{n}").over(earlier).alias(f"_o_{n}") for n in names])
    offsets = carried.filter("_end = 0").drop("_end").withColumnRenamed("_range", "_o_range")
    met = local.join(F.broadcast(offsets), F.col("_head") & (F.col("_range") == F.col("_o_range")), "left")  # one row a range
    return met.select(*kept, *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in names])


def rank_rows(
    df: DataFrame,
    key: str,
    *,
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    out: str = "pos",
    ranges: int | None = None,
) -> DataFrame:
    """Add the dense zero-based position of each row in ``(key, *tie)`` order, per group."""
    if by:
        ranked = running_sums(df, key, {out: F.lit(1).cast("bigint")}, by=by, tie=tie, ranges=ranges)
        return ranked.withColumn(out, F.col(out) - 1)
    for c in (key, *tie):
        if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"no order for {df.schema[c].dataType.simpleString()}")
    # Of ordered ranges Spark's own row numbers, range << 33 | row, are all that is needed.
    kept = [c for c in df.columns if c != out]
    numbered = _in_ranges(df.select(*kept), [key, *tie], ranges).withColumn("_row", F.monotonically_increasing_id())
    local = cut_lineage(numbered)
    number = F.shiftright("_row", 33)
    totals = local.groupBy(number.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_range").alias("_o_range"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    met = local.join(F.broadcast(offsets), number == F.col("_o_range"))  # one row a range
    return met.select(*kept, (F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).alias(out))


def shuffle_rank(
    df: DataFrame, id_col: str, *, seed, by: Sequence[str] = (), out: str = "pos"
) -> DataFrame:
    """Add the position of each row in a seeded random order (ids must be unique)."""
    keyed = df.withColumn("_key", seeded_key(seed, id_col))
    return rank_rows(keyed, "_key", by=by, tie=[id_col], out=out).drop("_key")


def dense_ids(df: DataFrame, key: str, *, tie: Sequence[str] = (), out: str = "id") -> DataFrame:
    """Replace or add ``out`` with ``0, 1, 2, ...`` over the rows in ``(key, *tie)`` order."""
    if out == key:
        df = df.withColumnRenamed(key, "_order")
        return rank_rows(df, "_order", tie=tie, out=out).drop("_order")
    return rank_rows(df, key, tie=tie, out=out)
