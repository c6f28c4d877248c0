"""Joins of raw child rows to their parents where a few keys may hold much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(many: DataFrame, key: str) -> DataFrame | None:
    """The keys that hold more than half of an even share of a shuffle partition; None where there are none.

    There are at most twice as many as partitions, however large the table is. Counts are partly formed before the shuffle.
    """
    spark = many.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = many.filter(F.col(key).isNotNull()).groupBy(key).count()
    most = counts.orderBy(F.desc("count")).limit(2 * partitions).collect()
    total = many.count() if most else 0
    heavy = [(r[key],) for r in most if 2 * partitions * r["count"] > total]
    kind = dict(many.dtypes)[key]
    return spark.createDataFrame(heavy, f"`{key}` {kind}") if heavy else None


def join_parents(many: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Inner join of ``many`` rows a key with at most one parent row each.

    Rows of heavy keys stay where they are and meet a broadcast of those keys' parents, which has at most two rows a shuffle
    partition; all others are joined as the optimiser likes.
    """
    heavy = heavy_keys(many, key)
    if heavy is None:
        return many.join(parents, key)
    known = F.broadcast(heavy)
    apart = many.join(F.broadcast(parents.join(known, key, "left_semi")), key)
    return many.join(known, key, "left_anti").join(parents, key).unionByName(apart)
