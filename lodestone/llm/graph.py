"""Connected components by alternating large-star and small-star steps, in DataFrame functions only.

Every step is a map-side combined minimum by node, a join with it and a distinct; each pair of steps is written to the
shared folder. A hub is an ordinary key of a minimum (combined before the shuffle) and of a join whose large partitions
adaptive execution splits; neighbours of a node are never gathered. The steps end in stars around each smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node with an edge to another; self-loops and nulls are ignored."""
    links = _pairs(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    links, last = scratch.cut(links, "links"), None
    while True:
        stars = scratch.cut(_small_star(_large_star(links)), "stars")
        scratch.drop(links)
        links = stars
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last = now
    roots = links.groupBy("v").agg(F.first("v").alias("component")).select(F.col("v").alias("node"), "component")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _pairs(df: DataFrame) -> DataFrame:
    """Distinct pairs with u > v."""
    return df.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    links = links.distinct()
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
