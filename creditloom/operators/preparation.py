"""Preparing model inputs: every step is fitted on given rows and applied to any rows as expressions.

What a step learns is small (one number or one short vocabulary per column), so it becomes literals in the plan
and applying it costs neither a join nor a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.quantiles import exact_quantiles

UNSEEN = -1.0

# Fixed value: at most this many indicator columns per categorical, the shared one for rare values included.
MAX_CATEGORIES = 20
INFREQUENT = "infrequent"


# --- categorical codes -------------------------------------------------------------------------------------


def fit_codes(train: DataFrame, columns: Sequence[str]) -> StringIndexerModel:
    """Alphabetical integer codes of the categories seen in ``train``."""
    return StringIndexer(
        inputCols=list(columns),
        outputCols=[f"{c}_code" for c in columns],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    ).fit(train)


def encode_categoricals(df: DataFrame, codes: StringIndexerModel) -> DataFrame:
    """Add ``<column>_code``; missing and unseen categories become -1."""
    encoded = codes.transform(df)
    outputs = codes.getOutputCols()
    return encoded.withColumns(
        {
            c: F.when(F.col(c) < len(labels), F.col(c)).otherwise(UNSEEN)
            for c, labels in zip(outputs, codes.labelsArray)
        }
    )


# --- imputation --------------------------------------------------------------------------------------------


def fit_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per numeric column; a column without values gets 0."""
    found = exact_quantiles(train, columns, [0.5]).collect()
    return dict.fromkeys(columns, 0.0) | {r["column_name"]: r["value"] for r in found}


def fit_modes(train: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent category per column, the alphabetically first among equals."""
    modes = category_counts(train, columns).groupBy("column_name").agg(
        F.min_by("category", F.struct(-F.col("rows"), F.col("category"))).alias("mode")
    )
    return {r["column_name"]: r["mode"] for r in modes.collect()}


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, category, rows`` for several categorical columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("category")) for c in columns])
    return (
        df.select(F.inline(pairs))
        .filter(F.col("category").isNotNull())
        .groupBy("column_name", "category")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def impute(df: DataFrame, values: Mapping[str, float | str]) -> DataFrame:
    """Replace missing values of the given columns."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


# --- scaling -----------------------------------------------------------------------------------------------


def fit_scaling(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; a constant column is only centred.

    The columns are summarised as one vector, which compiles to one aggregate whatever their number.
    """
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(train)
    facts = vectors.agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")).first()["s"]
    n = facts["count"]
    # The summary holds sample variances.
    deviations = [math.sqrt(v * (n - 1) / n) for v in facts["variance"]]
    return {c: (float(m), d or 1.0) for c, m, d in zip(columns, facts["mean"], deviations)}


def scaled(column: str, mean: float, deviation: float) -> Column:
    return (F.col(column) - F.lit(mean)) / F.lit(deviation)


def standardize(df: DataFrame, scaling: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: scaled(c, mean, deviation) for c, (mean, deviation) in scaling.items()})


# --- one-hot -----------------------------------------------------------------------------------------------


def one_hot_map(train: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> DataFrame:
    """``column_name, category, rows, is_frequent, slot``: which indicator each category sets.

    Columns with more than ``limit`` categories keep the ``limit - 1`` most frequent ones; all others share the
    last slot. Slots follow the alphabet.
    """
    by_frequency = Window.partitionBy("column_name").orderBy(F.desc("rows"), F.desc("category"))
    alphabet = Window.partitionBy("column_name").orderBy("category")
    whole = Window.partitionBy("column_name")
    # These windows see one row per category.
    ranked = category_counts(train, columns).withColumns(
        {"place": F.row_number().over(by_frequency), "categories": F.count(F.lit(1)).over(whole)}
    )
    frequent = (F.col("categories") <= limit) | (F.col("place") < limit)
    slot = F.sum(F.col("is_frequent").cast("long")).over(
        alphabet.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranked.withColumn("is_frequent", frequent)
        .withColumn("slot", F.when(F.col("is_frequent"), slot - 1).otherwise(F.lit(limit - 1).cast("long")))
        .select("column_name", "category", "rows", "is_frequent", "slot")
    )


def fit_frequent(train: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> dict[str, dict[str, list[str]]]:
    """Frequent and rare categories per column, from ``one_hot_map``."""
    found = {c: {"frequent": [], "rare": []} for c in columns}
    for row in one_hot_map(train, columns, limit).orderBy("column_name", "category").collect():
        found[row["column_name"]]["frequent" if row["is_frequent"] else "rare"].append(row["category"])
    return found


def indicator_columns(vocabulary: Mapping[str, Mapping[str, Sequence[str]]]) -> dict[str, Column]:
    """One 0/1 column per slot; a category never seen sets none of them."""
    indicators = {}
    for column, groups in vocabulary.items():
        for category in groups["frequent"]:
            indicators[f"{column}={category}"] = (F.col(column) == category).cast("double")
        if groups["rare"]:
            indicators[f"{column}={INFREQUENT}"] = F.col(column).isin(list(groups["rare"])).cast("double")
    return indicators
