"""Connected components of a stored table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.sources.intermediate import materialise


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that links reach) of every node in ``links`` (columns a and b, longs).

    Each round hangs every node's larger neighbours on its smallest one, then its smaller neighbours and itself as well,
    until nothing changes: then every node hangs on the smallest of its component. The number of rounds grows with
    the logarithm of a component's size. Each round is stored, so lost executors cost one round at most. A node with
    very many links is only ever grouped by a minimum, which is partly formed before the shuffle.
    """
    current = materialise(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links"
    )
    before = None
    while True:
        stars = materialise(_small_star(_large_star(current)), "links")
        state = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())
        if state == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        current, before = stars, state


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
