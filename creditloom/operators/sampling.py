"""Seeded, stratified sampling and splitting by the hash of the client id.

A row's place in a sample depends only on its own id, never on row order. Exact quotas are met without
sorting the table: a histogram of the hash (a fixed number of cells per stratum) locates the cell in which
each quota ends, and only that cell is ranked. What comes out is a pair (hash, id) per stratum and quota, so
membership of any row is a plain comparison and wide rows are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions import HASH_SPACE, spread_hash
from creditloom.operators.application import ID, LABEL
from creditloom.sources.intermediate import materialise

# Size of the reduced portfolio and the share of unlabelled applicants it keeps.
REDUCED_PORTFOLIO_SIZE = 50_000
UNLABELLED_PERCENT = 16

_CELL_BITS = 14
_CELL_SHIFT = HASH_SPACE.bit_length() - 1 - _CELL_BITS

#: quotas(stratum size, table size) -> number of rows, in hash order, before each cut
Quotas = Callable[[int, int], Sequence[int]]


def _cell(key: str, seed: int) -> Column:
    return F.shiftright(spread_hash(key, seed), _CELL_SHIFT)


@dataclass(frozen=True)
class HashCuts:
    """Where each quota of each stratum ends in hash order."""

    key: str
    stratum: str
    seed: int
    sizes: Mapping[object, int]
    #: stratum -> one (hash, id) per cut; None when the quota is empty
    ends: Mapping[object, Sequence[tuple[int, int] | None]]

    def before(self, cut: int) -> Column:
        """Whether a row lies within the given cut of its stratum; NULL for a row without a stratum."""
        place = F.struct(spread_hash(self.key, self.seed).alias("h"), F.col(self.key).cast("long").alias("k"))
        condition = F.when(F.col(self.stratum).isNull(), F.lit(None).cast("boolean"))
        for stratum, ends in self.ends.items():
            end = ends[cut]
            inside = F.lit(False)
            if end is not None:
                inside = place <= F.struct(F.lit(end[0]).cast("long"), F.lit(end[1]).cast("long"))
            condition = condition.when(F.col(self.stratum) == F.lit(stratum), inside)
        return condition.otherwise(F.lit(False))

    def group(self) -> Column:
        """0 before the first cut, 1 between the first and the second, and so on; NULL without a stratum."""
        cuts = len(next(iter(self.ends.values())))
        group = F.when(F.col(self.stratum).isNull(), F.lit(None).cast("int"))
        for cut in range(cuts):
            group = group.when(self.before(cut), cut)
        return group.otherwise(cuts)


def fit_hash_cuts(
    df: DataFrame, quotas: Quotas, key: str = ID, stratum: str = LABEL, seed: int = 0
) -> HashCuts:
    """Locate every quota: one aggregate, then a ranking of the few cells in which quotas end.

    The driver sees one size per stratum and one row per cut; the counts of the cells stay distributed. Rows whose stratum is
    NULL take no part: they are in no sample, and their split or fold is NULL.
    """
    spark = df.sparkSession
    kind = df.select(F.col(stratum).alias("stratum")).schema["stratum"].dataType.simpleString()
    marked = df.filter(F.col(stratum).isNotNull()).select(
        F.col(stratum).alias("stratum"),
        F.col(key).cast("long").alias("k"),
        spread_hash(key, seed).alias("h"),
        _cell(key, seed).alias("cell"),
    )
    # At most 2 ** 14 cells a stratum.
    counted = materialise(marked.groupBy("stratum", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = {r["stratum"]: r["n"] for r in counted.groupBy("stratum").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        raise ValueError("no rows to cut")
    total = sum(sizes.values())
    asked = {s: [min(quota, n) for quota in quotas(n, total)] for s, n in sizes.items()}
    ends: dict[object, list[tuple[int, int] | None]] = {s: [None] * len(q) for s, q in asked.items()}
    cuts = [(s, i, quota) for s, of_stratum in asked.items() for i, quota in enumerate(of_stratum) if quota >= 1]
    if cuts:
        upto = F.sum("n").over(Window.partitionBy("stratum").orderBy("cell"))
        ladder = counted.withColumn("upto", upto)
        wanted = spark.createDataFrame(cuts, f"stratum {kind}, cut int, quota long")
        # The cell in which a quota ends, and its last row's place there.
        inside = (F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota"))
        marks = ladder.join(wanted, "stratum").filter(inside)
        marks = materialise(marks.select("stratum", "cell", "cut", (F.col("quota") - F.col("upto") + F.col("n")).alias("rank")), "marks")
        # One row per cut on the right.
        in_cells = marked.join(marks.select("stratum", "cell").distinct(), ["stratum", "cell"], "left_semi")
        order = Window.partitionBy("stratum", "cell").orderBy("h", "k")
        ranked = in_cells.withColumn("rank", F.row_number().over(order).cast("long"))
        for r in ranked.join(marks, ["stratum", "cell", "rank"]).select("stratum", "cut", "h", "k").collect():
            ends[r["stratum"]][r["cut"]] = (r["h"], r["k"])
    return HashCuts(key, stratum, seed, sizes, ends)


def _nearest(x: float) -> int:
    return math.floor(x + 0.5)


# --- samples -----------------------------------------------------------------------------------------------


def stratified_sample(
    df: DataFrame, size: int = REDUCED_PORTFOLIO_SIZE, key: str = ID, stratum: str = LABEL, seed: int = 0
) -> DataFrame:
    """About ``size`` rows in which every stratum keeps its share (and at least one row)."""
    cuts = fit_hash_cuts(df, lambda n, total: [max(1, _nearest(size * n / total))], key, stratum, seed)
    return df.filter(cuts.before(0))


def hash_percent_sample(df: DataFrame, percent: int = UNLABELLED_PERCENT, key: str = ID, seed: int = 0) -> DataFrame:
    """Rows whose hash falls into the first ``percent`` of every hundred; needs no label and no pass."""
    return df.filter(spread_hash(key, seed) % 100 < percent)


def hash_order_sample(df: DataFrame, size: int, key: str = ID, seed: int = 0) -> DataFrame:
    """The first ``size`` rows in hash order, which spreads them over the whole portfolio."""
    return df.orderBy(spread_hash(key, seed), F.col(key)).limit(size)


def stratified_rank(df: DataFrame, key: str = ID, stratum: str = LABEL, seed: int = 0) -> DataFrame:
    """Rank of every row in hash order inside its stratum, with both population sizes.

    A stratum may hold nearly all rows, so it is ranked cell by cell; the cells' offsets come from a histogram
    with a fixed number of cells per stratum, which AQE broadcasts when it is small.
    """
    marked = df.select(key, stratum).withColumns(
        {"_h": spread_hash(key, seed), "_cell": _cell(key, seed)}
    )
    inside = Window.partitionBy(stratum, "_cell").orderBy("_h", key)
    earlier = Window.partitionBy(stratum).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    histogram = marked.groupBy(stratum, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    offsets = histogram.select(
        F.col(stratum).alias("_s"),
        F.col("_cell").alias("_c"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(stratum)).alias("stratum_n"),
        F.sum("_n").over(Window.partitionBy()).alias("total_n"),
    )
    same = F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c"))
    return (
        marked.withColumn("_row", F.row_number().over(inside))
        .join(offsets, same)
        .select(key, stratum, (F.col("_before") + F.col("_row")).alias("rn"), "stratum_n", "total_n")
    )


# --- splits ------------------------------------------------------------------------------------------------

# A fifth is held out and a tenth of the rest stops training early. The held-out fifth is halved,
# so that the rows that fit the calibration are not the rows that judge it.
SPLIT_SHARES: tuple[tuple[str, float], ...] = (("test", 0.10), ("calibrate", 0.10), ("early_stop", 0.08))
REMAINDER = "fit"


def fit_split(df: DataFrame, key: str = ID, stratum: str = LABEL, seed: int = 0) -> HashCuts:
    shares = list(accumulate(share for _, share in SPLIT_SHARES))
    return fit_hash_cuts(df, lambda n, _: [_nearest(n * share) for share in shares], key, stratum, seed)


def split_name(cuts: HashCuts) -> Column:
    names = [name for name, _ in SPLIT_SHARES] + [REMAINDER]
    group = cuts.group()
    return F.when(group.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in names]), group + 1))


def assign_split(df: DataFrame, key: str = ID, stratum: str = LABEL, seed: int = 0) -> DataFrame:
    """Add ``split``: stratified, disjoint and independent of row order; NULL for unlabelled rows."""
    return df.withColumn("split", split_name(fit_split(df, key, stratum, seed)))


def assign_fold(df: DataFrame, folds: int = 5, key: str = ID, stratum: str = LABEL, seed: int = 0) -> DataFrame:
    """Add ``fold`` (from 1): within a stratum, fold sizes differ by at most one; NULL for unlabelled rows."""
    cuts = fit_hash_cuts(df, lambda n, _: [n * i // folds for i in range(1, folds)], key, stratum, seed)
    return df.withColumn("fold", cuts.group() + 1)


# --- class balance -----------------------------------------------------------------------------------------


def undersample_majority(df: DataFrame, key: str = ID, label: str = LABEL, seed: int = 0) -> DataFrame:
    """All rows of the smaller class and as many of the larger, drawn in hash order."""
    counts = {r[0]: r[1] for r in df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    smallest = min(counts.values())
    cuts = fit_hash_cuts(df, lambda n, _: [smallest], key, label, seed)
    return df.filter(cuts.before(0))


def positive_weight(df: DataFrame, label: str = LABEL) -> float:
    """Negatives per positive."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    return row["neg"] / max(row["pos"], 1)


def class_weights(df: DataFrame, label: str = LABEL, name: str = "weight") -> DataFrame:
    """Add a weight that makes both classes count the same: positives weigh negatives per positive."""
    return df.withColumn(name, F.when(F.col(label) == 1, positive_weight(df, label)).otherwise(1.0))
