"""Signed contributions of features to scores, for whole portfolios.

Contributions stay in one array per applicant until they are reported, so ranking the factors of an applicant
needs no shuffle and global importance is a single aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import FINE_PLACES, display_number, exact_mean, humanise
from creditloom.operators.boosting import BoostedTrees, matrix_of
from creditloom.operators.trees import Path, paths

# Factors shown per applicant and features in the overall ranking.
TOP_FACTORS = 6
TOP_FEATURES = 30
# Rows whose contributions are worked out together.
_LOT = 1 << 15
# Of these, rows that stay in a core's cache; and conditions of a path of which all patterns are laid out.
_BLOCK = 1 << 14
_LAID_OUT = 12

INCREASES, DECREASES = "increases_risk", "decreases_risk"


# --- linear models -----------------------------------------------------------------------------------------


def linear_contribution(feature: str, weight: float, mean: float) -> Column:
    """Push of one feature against its average; a missing value is taken to be average."""
    return F.lit(weight) * (F.coalesce(F.col(feature).cast("double"), F.lit(mean)) - F.lit(mean))


def linear_contributions(
    df: DataFrame, weights: Mapping[str, float], means: Mapping[str, float], key: str
) -> DataFrame:
    """``key, contributions``: an array of ``feature, value, contribution`` per row."""
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f).cast("double").alias("value"),
            linear_contribution(f, w, means[f]).alias("contribution"),
        )
        for f, w in weights.items()
    ]
    return df.select(key, F.array(*entries).alias("contributions"))


# --- boosted trees -----------------------------------------------------------------------------------------


def leaf_pushes(value: float, shares: np.ndarray, holds: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf for patterns of held conditions (one row a pattern, one column an input).

    The leaf is a game that is worth its value times, for each input, 1 or 0 where the input is known and its share of the
    training rows where it is not. Averaged over all orders, input j pushes by the integral over t from 0 to 1 of
    (held_j - share_j) times the product over the others of (1 - t) * share + t * held. That is a polynomial in t, which
    Gauss-Legendre nodes integrate exactly, so d inputs cost d * d steps and not 2 ** d.
    """
    d = len(shares)
    nodes, weights = _nodes(d // 2 + 1)
    t = (nodes + 1.0)[:, None, None] / 2.0
    mixed = (1.0 - t) * shares + t * holds
    ahead, behind = np.ones_like(mixed), np.ones_like(mixed)
    for j in range(1, d):
        ahead[:, :, j] = ahead[:, :, j - 1] * mixed[:, :, j - 1]
        behind[:, :, d - 1 - j] = behind[:, :, d - j] * mixed[:, :, d - j]
    others = np.tensordot(weights / 2.0, ahead * behind, axes=1)
    return value * (holds - shares) * others


@cache
def _nodes(count: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(count)


@cache
def _patterns(d: int) -> np.ndarray:
    """Every pattern of ``d`` held conditions, at its number's place."""
    return (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(np.float64)


def _add_pushes(path: Path, bins: np.ndarray, out: np.ndarray) -> None:
    """Adds a path's pushes to those of rows that lie input by input."""
    features, shares = [c.feature for c in path.conditions], np.array([c.share for c in path.conditions])
    bits = [c.passes.astype(np.int64) << i for i, c in enumerate(path.conditions)]
    pushes = np.ascontiguousarray(leaf_pushes(path.value, shares, _patterns(len(bits))).T) if len(bits) <= _LAID_OUT else None
    for first in range(0, bins.shape[1], _BLOCK):
        own, block = out[:, first : first + _BLOCK], bins[:, first : first + _BLOCK]
        number = bits[0].take(block[features[0]])
        for bit, f in zip(bits[1:], features[1:]):
            number += bit.take(block[f])
        found = pushes
        if found is None:
            # Of a long path only the patterns that rows have.
            met, number = np.unique(number, return_inverse=True)
            found = leaf_pushes(path.value, shares, (met[:, None] >> np.arange(len(bits)) & 1).astype(np.float64)).T
        for f, pushed in zip(features, found):
            own[f] += pushed.take(number)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches that together have about ``_LOT`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= _LOT:
            yield held
            held = []
    if held:
        yield held


def tree_contributions(rows: DataFrame, model: BoostedTrees, key: str, shown: str | None = None) -> tuple[DataFrame, float]:
    """Path-dependent Shapley contributions to the log-odds, and the base value they start from.

    ``rows`` holds ``key``, the inputs ``x`` and, where asked for, ``shown``: their raw values as text. The trees travel to
    the executors once; their paths are laid out there, and a path's pushes are worked out once for each pattern of held
    conditions that a lot of rows may have.
    """
    inputs, trees = model.inputs, rows.sparkSession.sparkContext.broadcast(model.trees)
    kept = [key, shown or "x"]
    kinds = dict(rows.dtypes)

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = [path for tree in trees.value for path in paths(tree) if path.conditions]
        for lot in _lots(batches):
            bins = np.ascontiguousarray(np.concatenate([inputs.binned(matrix_of(batch["x"], len(inputs.names))) for batch in lot]).T)
            pushes = np.zeros(bins.shape)
            for path in ways:
                _add_pushes(path, bins, pushes)
            done = 0
            for batch in lot:
                own = pushes[:, done : done + batch.num_rows].T
                done += batch.num_rows
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1]), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], flat], [*kept, "pushes"])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "pushes array<double>"])
    pushed = rows.select(*dict.fromkeys([*kept, "x"])).mapInArrow(attribute, schema)
    labels = F.array(*[F.lit(n) for n in inputs.names])
    value, kind = (F.col(shown), "string") if shown else (F.col("x"), "double")
    entries = F.arrays_zip(labels.alias("feature"), value.alias("value"), F.col("pushes").alias("contribution"))
    shape = f"array<struct<feature: string, value: {kind}, contribution: double>>"
    base = model.base + sum(
        path.value * float(np.prod([c.share for c in path.conditions])) for tree in model.trees for path in paths(tree)
    )
    return pushed.select(key, entries.cast(shape).alias("contributions")), base


# --- reports -----------------------------------------------------------------------------------------------


def contribution_rows(contributions: DataFrame, key: str) -> DataFrame:
    return contributions.select(key, F.inline("contributions"))


def top_n_per_row(contributions: DataFrame, key: str, n: int) -> DataFrame:
    """The n largest contributions by size, with their rank; equal sizes keep the alphabetical order."""
    keyed = F.transform(
        "contributions",
        lambda c: F.struct((-F.abs(c["contribution"])).alias("size"), c["feature"].alias("name"), c.alias("c")),
    )
    best = F.slice(F.array_sort(keyed), 1, n)
    return contributions.select(key, F.posexplode(best).alias("place", "item")).select(
        key,
        (F.col("place") + 1).cast("long").alias("rank"),
        "item.c.feature",
        "item.c.value",
        "item.c.contribution",
    )


def _value_kind(contributions: DataFrame) -> str:
    return contributions.schema["contributions"].dataType.elementType["value"].dataType.simpleString()


def top_factors(contributions: DataFrame, key: str, n: int = TOP_FACTORS) -> DataFrame:
    """The factors to show for each applicant: label, readable value and direction."""
    return top_n_per_row(contributions, key, n).select(
        key,
        "rank",
        "feature",
        humanise("feature").alias("label"),
        (F.col("value") if _value_kind(contributions) == "string" else display_number("value")).alias("value"),
        F.round("contribution", 4).alias("contribution"),
        F.when(F.col("contribution") > 0, INCREASES).otherwise(DECREASES).alias("direction"),
    )


def global_importance(contributions: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """Mean absolute contribution per feature over the whole portfolio, largest first."""
    flat = contributions.select(F.inline("contributions"))
    ranked = flat.groupBy("feature").agg(exact_mean(F.abs("contribution"), FINE_PLACES).alias("mean_abs_contribution"))
    return (
        ranked.withColumn("label", humanise("feature"))
        .orderBy(F.desc("mean_abs_contribution"), "feature")
        .limit(n)
    )
