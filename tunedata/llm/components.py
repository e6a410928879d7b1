"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tunedata.session import cut_lineage


def _towards_least(pairs: DataFrame) -> DataFrame:
    """Of (node, near): (node, near, least), with the least of the node and all it is near to."""
    least = pairs.groupBy("node").agg(F.min("near").alias("least"))
    return pairs.join(least.select("node", F.least("node", "least").alias("least")), "node")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): for every node that has a link, the least node of its component.

    Two steps in turn until nothing changes: every node hands the least of its neighbours to its
    greater ones, then to its smaller ones. Components end as stars around their least node. The
    links never grow in number, a hot node is one join key that can be split, and each round's links
    are a written table. Links of a node with itself, or with null, are no links.
    """
    a, b = F.col(left), F.col(right)
    now = cut_lineage(links.filter(a != b).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("near")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("near").alias("node"), F.col("node").alias("near")))
        large = _towards_least(both).filter("near > node").select(F.col("near").alias("node"), F.col("least").alias("near")).distinct()
        known = _towards_least(large)
        small = known.select("node", F.col("least").alias("near")).union(known.filter("near != least").select(F.col("near").alias("node"), F.col("least").alias("near")))
        now = cut_lineage(small.distinct())
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("node", "near").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == state:
            return now.select("node", F.col("near").alias("root")).union(now.select(F.col("near").alias("node"), F.col("near").alias("root")).distinct())
        state = seen
