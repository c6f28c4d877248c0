"""Balanced contiguous shards from global byte prefix sums.

Documents are put in one order, by (digest of the text, id), which lays equal texts side by side. The order is stored
in range partitions; a document's prefix sum is its partition's total offset plus the running sum inside the partition.
The line of all bytes is cut at equal targets, so a shard's size differs from the mean by at most one document at
either end. A group of equal texts that a target would split goes whole to the side of its middle when it is no larger
than the largest single document; a larger group is cut, since keeping it whole would unbalance the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.operators.ordering import running_totals

# What a document costs beside its text.
ROW_BYTES = 16


def shards(documents: DataFrame, n_shards: int) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard (from 0) and slot (its place in the shard, from 0).

    Size is the text's UTF-8 bytes plus 16; a null text has none and counts as empty. Repeated rows are documents of
    their own. No documents give no rows. Columns besides doc_id and text are not read.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.md5(raw).alias("digest"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = running_totals(sized, [F.col("digest"), F.col("doc_id")], ["size", "one"])
    largest = placed.agg(F.max("size")).first()[0] or 0
    # Equal texts share a digest; partial aggregates reduce a hot group before it is shuffled.
    whole = (
        placed.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("size_before").alias("start"), F.sum("size").alias("group_size"))
        .filter((F.col("copies") > 1) & (F.col("group_size") <= F.lit(largest)))
        .select("digest", (F.col("start") * 2 + F.col("group_size")).alias("group_middle"))
    )
    own_middle = F.col("size_before") * 2 + F.col("size")
    shard = _cut(F.coalesce("group_middle", own_middle), n_shards)
    dealt = placed.join(whole, "digest", "left").withColumn("shard", shard)
    # Shards are runs of the one order, so a place in a shard is a difference of places in the order.
    first = dealt.groupBy("shard").agg(F.min("one_before").alias("first"))
    return dealt.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("one_before") - F.col("first")).alias("slot")
    )


def _cut(twice_the_middle: Column, n_shards: int) -> Column:
    """The shard on whose stretch of the byte line a middle lies, in whole numbers."""
    number = F.floor(twice_the_middle.cast("decimal(38,0)") * n_shards / (F.col("size_total") * 2).cast("decimal(20,0)"))
    return F.least(number, F.lit(n_shards - 1)).cast("int")
