"""Mix sources to target weights along a low-discrepancy schedule of equal blocks.

Each source's documents, in a seeded shuffled order, form one stream of words that is read again
from its start when a target asks for more than one pass. The stream is cut into blocks of equal
size. A van der Corput sequence (bit reversal in base 2) over the cumulative block quotas of the
sources says which source each slot of the mix serves; the n-th slot of a source takes the n-th
block of its stream. The points of 2^k slots are all multiples of 2^-k, each once, so every source
gets exactly its quota of slots, spread evenly.

Only ids, sizes and digests move; texts are read once. A hot source is no hot task: running sums
go bucket by bucket of the shuffle digest, slots are made in chunks, and blocks join one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tunedata.llm.text import word_count
from tunedata.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 256

#: Rows of one bucket of the shuffle and slots of one chunk of the schedule: what one window sorts at once.
BUCKET_ROWS = 20_000
CHUNK_BITS = 16


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Words to take per source, from (source, source_size).

    The sources, by code point with null last, weigh ``weights`` in turn and share ``share`` times
    all words by weight. None takes more than ``cap`` times its size; what is cut off is shared by
    weight among the others until none is above. In the order of size by weight this is one pass:
    the sources met before the first that stays below its limit are the limited ones.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("rank", rank).withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")).asc(), "rank")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    levelled = ranked.withColumn("level", level).withColumn("limited", F.col("level") * F.col("weight") >= F.col("most"))
    common = F.max(F.when(~F.col("limited"), F.col("level"))).over(whole)
    return levelled.withColumn("target", F.when(F.col("limited"), F.col("most").cast("double")).otherwise(common * F.col("weight"))).select(
        "source", "rank", "source_size", "target", F.round("target").cast("long").alias("words"))


def _bit_reverse(number: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(number), max(bits, 1), "0")), 2, 10).cast("long")


def slot_schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, rank, block): which block of which source each slot of the mix takes.

    ``sources``: (rank, words). A point p of the van der Corput sequence belongs to the source in
    whose stretch of the cumulative quotas it falls; its slot is p with its bits reversed, so the
    slots of a source are made from its stretch. The block is the slot's rank within its source.
    """
    quota = F.ceil(F.col("words") / block_words).cast("long")
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    quotas = sources.select("rank", quota.alias("quota")).withColumn("first", F.coalesce(F.sum("quota").over(upto), F.lit(0)))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    bits = max(int(total) - 1, 0).bit_length()
    size = 1 << CHUNK_BITS
    stretches = (
        quotas.filter("quota > 0")
        .select("rank", "first", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / size))).alias("part"))
        .repartition("rank", "part")
    )
    low = F.col("first") + F.col("part") * size
    points = stretches.select("rank", F.explode(F.sequence(low, F.least(low + size, F.col("first") + F.col("quota")) - 1)).alias("point"))
    slots = points.select("rank", _bit_reverse(F.col("point"), bits).alias("slot")).withColumn("chunk", F.shiftright("slot", CHUNK_BITS))
    counts = slots.groupBy("rank", "chunk").count()
    earlier = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("rank", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")) - 1
    return slots.withColumn("within", within).join(offsets.hint("merge"), ["rank", "chunk"]).select("slot", "rank", (F.col("offset") + F.col("within")).alias("block"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS,
    share: float = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their targets, and the mix itself.

    Documents: (doc_id, source, size, source_size, target, rank, start), one per row of ``docs``.
    Mix: (slot, rank, block, start, first_word, n_words), one per stretch of a document in a block;
    (rank, start) names the document. Its words from ``first_word`` on, ``n_words`` of them, stand
    in that slot.

    Null and empty texts have size 0 and are never taken. A null source is one source, the last. Ids
    may be null or repeated: rows are ordered by a digest of id and text, and equal rows may
    exchange their places. An empty table gives empty results. Other columns are not read.
    """
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    base = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), name.alias("digest")))
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = cut_lineage(source_targets(totals.drop("n"), weights, share, cap).coalesce(1))
    rows = totals.agg(F.sum("n")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS + 1, 16)))

    by = ["rank", "bucket"]
    known = sources.withColumnRenamed("source", "known")
    placed = base.join(known, F.col("source").eqNullSafe(F.col("known"))).drop("known").withColumn("bucket", F.substring("digest", 1, digits))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*by).agg(F.sum("size").alias("in_bucket")).select(*by, F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("bucket_start"))
    within = Window.partitionBy(*by).orderBy("digest", "size", F.col("doc_id")).rowsBetween(Window.unboundedPreceding, -1)
    located = (
        placed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, by)
        .withColumn("start", F.col("bucket_start") + F.col("before"))
    )
    located = cut_lineage(located.select("doc_id", "source", "size", "source_size", "target", "words", "rank", "start"))

    passes = F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("source_size")))
    read = located.filter("size > 0 AND words > 0").select("rank", "start", "size", "words", "source_size", F.explode(passes).alias("turn"))
    low = F.col("turn") * F.col("source_size") + F.col("start")
    read = read.withColumn("low", low).withColumn("high", F.least(F.col("low") + F.col("size"), "words")).filter("low < high")
    pieces = read.select("rank", "start", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / block_words), F.floor((F.col("high") - 1) / block_words))).alias("block"))
    first, last = F.greatest("low", F.col("block") * block_words), F.least("high", (F.col("block") + 1) * block_words)
    pieces = pieces.select("rank", "start", "block", (first - F.col("low")).alias("first_word"), (last - first).alias("n_words"))
    # Slots are made from a few rows, by whose size Spark would take them to be few themselves and broadcast them.
    slots = slot_schedule(sources, block_words)
    return located.drop("words"), pieces.join(slots.hint("merge"), ["rank", "block"]).select("slot", "rank", "block", "start", "first_word", "n_words")


def taken_words(located: DataFrame, mixed: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): what the mix takes of every document."""
    taken = mixed.groupBy("rank", "start").agg(F.sum("n_words").alias("words"))
    words = F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(0).cast("long")
    return located.join(taken, ["rank", "start"], "left").select("doc_id", "source", "size", "source_size", "target", words.alias("taken"))
