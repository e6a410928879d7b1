"""Near-duplicate groups of documents by fast similarity sketching, banding and exact links.

1. Each text becomes the set of its word shingles, and the set a fast similarity sketch (``sketch``).
   Texts with equal sets are one class from here on, however many copies there are.
2. A band is a few neighbouring coordinates. Classes that agree in a band meet in its bucket; the
   least of the bucket stands for it, so a bucket of any size gives one pair for each member.
3. The members that met under one representative are compared with each other on their full sets,
   all with all, by bit tables. Only links that join two so far separate sets of members are returned.
   A group of more than a block is first compared with its representative alone; what is one
   component with most of the group by then, over whatever links, needs nothing more, and only the others are
   compared with all, in pairs of blocks. So a large group of near copies is read twice, not once for
   each of its blocks.
4. Connected components of those links are the groups.

With 128 coordinates in 32 bands of 4, two sets at a similarity of 0.8 miss each other with a chance
of (1 - 0.8^4)^32, about 5e-8, and less above; no other step loses a link. Sets are told apart by
64-bit digests of their elements and two such digests of the whole set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tunedata.llm import sketch
from tunedata.llm.components import components
from tunedata.llm.text import row_key
from tunedata.session import cut_lineage

SHINGLE, PERCENT = 5, 80
COORDINATES, BAND_ROWS = 128, 4
#: Members and bytes of text of one block; a task compares at most two.
BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20


def sketched(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(key, size, class, check, bands) for every row; ``class`` and ``check`` are digests of the set, null for an empty one."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, classes, checks, keys = [], [], [], []
            for text in batch.pop("text"):
                elements = sketch.shingles(text, shingle)
                sizes.append(len(elements))
                classes.append(sketch.digest(elements) if len(elements) else None)
                checks.append(sketch.digest(elements, 1) if len(elements) else None)
                keys.append(sketch.bands(sketch.sketch(elements, COORDINATES), BAND_ROWS) if len(elements) else [])
            digests = {"class": pd.Series(classes, index=batch.index, dtype="Int64"), "check": pd.Series(checks, index=batch.index, dtype="Int64")}
            yield batch.assign(size=sizes, **digests, bands=pd.Series(keys, index=batch.index, dtype=object))

    parts = row_key(id_col, text_col)
    given = docs.select(parts.alias("key"), F.col(text_col).alias("text")).select(
        F.col("key.id").alias("id"), F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2"), F.col("key.none").alias("none"), "text")
    id_type = given.schema["id"].dataType.simpleString()
    # Nullable whole numbers would be floats in pandas, so they pass as strings.
    held_type = "string" if isinstance(given.schema["id"].dataType, T.IntegralType) else id_type
    made = given.withColumn("id", F.col("id").cast(held_type)).mapInPandas(run, f"id {held_type}, h1 long, h2 long, none boolean, size long, class long, check long, bands array<long>").withColumn("id", F.col("id").cast(id_type))
    return made.select(F.struct("id", "h1", "h2", "none").alias("key"), "size", "class", "check", "bands")


def distinct_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with one ``class`` for each set, and (class, id, key, bands) of every class.

    Should two sets share the first digest, which some pairs in 10^10 sets do, all that share it are told apart by the second.
    """
    def gathered(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.filter("size > 0").groupBy("class").agg(
            F.min("key.id").alias("id"), F.min("key").alias("key"), F.first("bands").alias("bands"), (F.min("check") != F.max("check")).alias("mixed")))

    classes = gathered(rows)
    mixed = classes.filter("mixed").select("class")
    if mixed.isEmpty():
        return rows, classes.drop("mixed")
    apart = rows.join(mixed.withColumn("mixed", F.lit(True)), "class", "left")
    rows = cut_lineage(apart.withColumn("class", F.when(F.col("mixed"), F.xxhash64("class", "check")).otherwise(F.col("class"))).drop("mixed"))
    return rows, gathered(rows).drop("mixed")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(rep, member): representatives of buckets and what met under them, themselves included."""
    buckets = classes.select("class", F.explode("bands").alias("band"))
    reps = buckets.groupBy("band").agg(F.min("class").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = cut_lineage(buckets.join(reps, "band").filter("class != rep").select("rep", F.col("class").alias("member")).distinct())
    return met.union(met.select("rep", F.col("rep").alias("member")).distinct())


def _linker(shingle: int, percent: int):
    def link(group: pd.DataFrame) -> pd.DataFrame:
        """Links between the members of a block, or between two blocks, that join separate trees."""
        sets = [sketch.shingles(t, shingle) for t in group["text"]]
        names, size = group["member"].to_numpy(), np.array([len(s) for s in sets])
        first = np.flatnonzero(group["block"] == group["low"])
        second = np.flatnonzero(group["block"] == group["high"]) if group["low"].iat[0] != group["high"].iat[0] else first
        alone = second is first
        shared = sketch.common([sets[i] for i in first], None if alone else [sets[i] for i in second])
        union = size[first][:, None] + size[second][None, :] - shared
        near = 100 * shared.astype(np.int64) >= percent * union
        if alone:
            near = np.triu(near, 1)
        tree = list(range(len(sets)))

        def root(i: int) -> int:
            while tree[i] != i:
                tree[i] = tree[tree[i]]
                i = tree[i]
            return i

        out = []
        for i, j in zip(*np.nonzero(near)):
            a, b = root(first[i]), root(second[j])
            if a != b:
                tree[max(a, b)] = min(a, b)
                out.append((names[first[i]], names[second[j]]))
        return pd.DataFrame(out, columns=["left", "right"]).astype("int64")

    return link


def _starlinker(shingle: int, percent: int):
    def link(group: pd.DataFrame) -> pd.DataFrame:
        """Links of the members of a block with their representative."""
        rep = group["rep"].iat[0]
        centre = sketch.shingles(group.loc[group["member"] == rep, "text"].iat[0], shingle)
        others = group[group["member"] != rep]
        found = []
        for name, text in zip(others["member"], others["text"]):
            own = sketch.shingles(text, shingle)
            both = len(np.intersect1d(centre, own, assume_unique=True))
            if 100 * both >= percent * (len(centre) + len(own) - both):
                found.append((rep, name))
        return pd.DataFrame(found, columns=["left", "right"]).astype("int64")

    return link


def _crosslinker(shingle: int, percent: int):
    def link(group: pd.DataFrame) -> pd.DataFrame:
        """Links between members outside a group's main component and members of another component."""
        sets = [sketch.shingles(t, shingle) for t in group["text"]]
        names, size, roots = group["member"].to_numpy(), np.array([len(s) for s in sets]), group["root"].to_numpy()
        few, all_of = np.flatnonzero(group["few"]), np.flatnonzero(~group["few"])
        if not len(few) or not len(all_of):
            return pd.DataFrame({"left": [], "right": []}).astype("int64")
        shared = sketch.common([sets[i] for i in few], [sets[i] for i in all_of])
        union = size[few][:, None] + size[all_of][None, :] - shared
        near = (100 * shared.astype(np.int64) >= percent * union) & (roots[few][:, None] != roots[all_of][None, :])
        tree: dict[int, int] = {}

        def root(i: int) -> int:
            while tree.get(i, i) != i:
                tree[i] = tree.get(tree[i], tree[i])
                i = tree[i]
            return i

        out = []
        for i, j in zip(*np.nonzero(near)):
            a, b = root(roots[few[i]]), root(roots[all_of[j]])
            if a != b:
                tree[max(a, b)] = min(a, b)
                out.append((names[few[i]], names[all_of[j]]))
        return pd.DataFrame(out, columns=["left", "right"]).astype("int64")

    return link


def _blocked(rows: DataFrame, into: str) -> DataFrame:
    """Rows (rep, member, bytes) with a block number and how many blocks their group has."""
    extent = rows.groupBy("rep").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias(f"{into}s"))
    return rows.join(extent, "rep").withColumn(into, F.pmod(F.xxhash64("member"), f"{into}s"))


def exact_links(groups: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(left, right): links of at least ``percent`` per cent within the groups (rep, member), enough to connect
    whatever is linked. ``texts``: (member, text), one row each."""
    kind = "left long, right long"
    sized = groups.join(texts.select("member", F.octet_length("text").alias("bytes")), "member")
    placed = cut_lineage(_blocked(sized, "block"))
    small = placed.filter("blocks = 1").join(texts, "member").withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    links = cut_lineage(small.groupBy("rep", "low", "high").applyInPandas(_linker(shingle, percent), kind))
    large = placed.filter("blocks > 1")
    if large.isEmpty():
        return links

    # The representative goes to every block of its group, all others to their own.
    own = F.when(F.col("member") == F.col("rep"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    starred = large.join(texts, "member").select("rep", "member", "text", F.explode(own).alias("block"))
    links = cut_lineage(links.unionByName(starred.groupBy("rep", "block").applyInPandas(_starlinker(shingle, percent), kind)))

    trees = components(links, "left", "right").withColumnRenamed("node", "member")
    rooted = cut_lineage(large.select("rep", "member", "bytes", "block", "blocks").join(trees, "member", "left").withColumn("root", F.coalesce("root", "member")))
    counts = rooted.groupBy("rep", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("rep").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    others = rooted.join(main, "rep").filter("root != main").select("rep", "member", "bytes", "root", "blocks")
    others = cut_lineage(_blocked(others.withColumnRenamed("blocks", "all_blocks"), "part"))
    if others.isEmpty():
        return links
    parts = others.groupBy("rep").agg(F.max("parts").alias("parts"))
    count = F.col("parts").cast("long")
    few = others.select("rep", "member", "root", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_blocks") - 1)).alias("block"), F.lit(True).alias("few"))
    rest = rooted.join(parts, "rep").select("rep", "member", "root", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("part"), "block", F.lit(False).alias("few"))
    met = few.unionByName(rest).join(texts, "member")
    crossed = cut_lineage(met.groupBy("rep", "part", "block").applyInPandas(_crosslinker(shingle, percent), kind))
    return links.unionByName(crossed)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept, group): one row for every row of ``docs``, ``key`` being ``text.row_key``.

    ``component_id`` is the least id that is reached over links, ``kept`` says whether it is the row's
    own. Null and empty texts have no shingles and are linked with nothing; a text of fewer words than
    a shingle is one shingle. ``group`` is the same for the rows of a group, null without shingles. Repeated rows are in one group and have the same ``kept``. A null id is
    linked like any other, but names a group only if all its ids are null. Other columns are not read.
    """
    rows, classes = distinct_sets(cut_lineage(sketched(docs, id_col, text_col, shingle)))
    groups = cut_lineage(candidate_groups(classes))
    wanted = classes.join(groups.select(F.col("member").alias("class")).distinct(), "class").select("key", F.col("class").alias("member"))
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    texts = cut_lineage(keyed.join(wanted, "key").select("member", "text").dropDuplicates(["member"]))
    links = cut_lineage(exact_links(groups, texts, shingle, percent))
    trees = components(links, "left", "right").withColumnRenamed("node", "class")
    placed = classes.select("class", "id").join(trees, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    named = placed.join(least, "root").select("class", F.col("root").alias("group"), "component_id")
    grouped = rows.select("key", "size", "class").join(named, "class", "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("key.id"))
    return grouped.select("key", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("key.id").eqNullSafe(component).alias("kept"), "group")
