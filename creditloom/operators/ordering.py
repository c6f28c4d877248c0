"""Positions and running totals over a whole table, without a single-task sort.

``Window.orderBy`` without a partition moves every row into one task. Here rows are range-partitioned and
sorted inside each partition (equal sort keys are told apart by the id, so one frequent value cannot fill a
partition), stored once, and each partition's offset is added afterwards. The only single-task step handles
one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.sources.intermediate import materialise

# monotonically_increasing_id() keeps the row number inside its partition in the low 33 bits.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def stored_in_order(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` range-partitioned and stored, with each row's partition (``_block``) and place (``_slot``)."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ordered.withColumn("_slot", F.monotonically_increasing_id()), "ordered").withColumn(
        "_block", F.shiftright("_slot", _ROW_BITS)
    )


def _with_offsets(ordered: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Attach, to every row, each sum over the earlier blocks (``_n_before``) and over all (``n_total``)."""
    per_block = ordered.groupBy("_block").agg(*[c.alias(f"_{name}") for name, c in sums.items()])
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    offsets = per_block.select(
        "_block",
        *[F.coalesce(F.sum(f"_{n}").over(earlier), zero).alias(f"_{n}_before") for n in sums],
        *[F.sum(f"_{n}").over(everything).alias(f"{n}_total") for n in sums],
    )
    # One row per range partition, whatever the size of the table.
    return ordered.join(F.broadcast(offsets), "_block")


def global_position(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add the 0-based ``position`` in ``order`` and the row count ``n_total``.

    ``order`` must end in a unique key.
    """
    ordered = _with_offsets(stored_in_order(df, order), {"n": F.count(F.lit(1))})
    position = F.col("_n_before") + F.col("_slot").bitwiseAND(F.lit(_ROW_MASK))
    return ordered.withColumn("position", position).drop("_slot", "_block", "_n_before")


def block_totals(ordered: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add, for each whole-number column ``c`` of a stored order, ``c_before`` (sum over earlier rows) and ``c_total``."""
    summed = _with_offsets(ordered, {c: F.sum(c) for c in columns})
    inside = Window.partitionBy("_block").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = {f"{c}_before": F.col(f"_{c}_before") + F.coalesce(F.sum(c).over(inside), zero) for c in columns}
    return summed.withColumns(totals).drop(*[f"_{c}_before" for c in columns])


def running_totals(df: DataFrame, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Add, for each whole-number column ``c``, ``c_before`` (sum over earlier rows) and ``c_total``."""
    return block_totals(stored_in_order(df, order), columns).drop("_slot", "_block")


def with_next(ordered: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add, for each column ``c`` of a stored order, ``next_c`` of the row that follows, NULL at the end.

    A block's last row is followed by the first one of the next block that has rows.
    """
    first = ordered.groupBy("_block").agg(F.min_by(F.struct(*columns), "_slot").alias("_first"))
    # One row per range partition.
    border = first.select("_block", F.lead("_first").over(Window.orderBy("_block")).alias("_border"))
    inside = Window.partitionBy("_block").orderBy("_slot")
    joined = ordered.withColumn("_inside", F.lead(F.struct(*columns)).over(inside)).join(F.broadcast(border), "_block")
    following = F.coalesce("_inside", "_border")
    return joined.withColumns({f"next_{c}": following[c] for c in columns}).drop("_inside", "_border")


def tile_of_position(tiles: int) -> Column:
    """The ``ntile`` number (from 1) of a ``position`` among ``n_total`` rows: the first tiles are larger."""
    position = F.col("position")
    small = F.expr(f"n_total DIV {tiles}")
    large_tiles = F.col("n_total") % tiles
    in_large = large_tiles * (small + 1)
    tile = F.when(position < in_large, F.floor(position / (small + 1))).otherwise(
        large_tiles + F.floor((position - in_large) / F.greatest(small, F.lit(1)))
    )
    return (tile + 1).cast("long")


def bin_of_position(bins: int) -> Column:
    """The bin number (from 1) when bin edges lie at ``floor(n_total * i / bins)``."""
    return F.expr(f"((position + 1) * {bins} - 1) DIV n_total") + 1


def global_ntile(df: DataFrame, tiles: int, order: Sequence[Column], name: str = "tile") -> DataFrame:
    """``ntile(tiles)`` over the whole table in ``order``, which must end in a unique key."""
    ranked = global_position(df, order)
    return ranked.withColumn(name, tile_of_position(tiles)).drop("position", "n_total")
