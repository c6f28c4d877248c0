"""Exact quantiles of many columns in a few scans.

Sorting a column, or handing it to an exact percentile aggregate, gathers it in one task. Instead a first
scan brackets each quantile with a mergeable approximate percentile, and a second scan counts what lies below
each bracket exactly and keeps only the distinct values inside it, with their counts. The brackets hold a
fraction of a percent of the rows, and frequent values are counted before anything is moved. Where that fraction could still
be more than ``_BRACKET`` values, brackets are narrowed first: rows below and inside are counted, the inside is sketched
again, and so on, so the last step sees a bounded number of values whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rank resolution of the sketch that brackets a quantile.
_ACCURACY = 10_000

# Values of one bracket that the last step may see.
_BRACKET = 200_000

_SCHEMA = "column_name string, probability double, value double"


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Rows ``(column_name, probability, value)`` by linear interpolation; columns without values are absent.

    NULLs are ignored, like in an aggregate.
    """
    spark = df.sparkSession
    # Expressions over many columns are written as SQL text: one call per column builds the plan much faster.
    numbers = df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in columns])
    accuracy = _ACCURACY
    # Twice the sketch's guaranteed rank error on both sides.
    margin = 2.0 / accuracy
    bounds = [b for p in probabilities for b in (max(p - margin, 0.0), min(p + margin, 1.0))]
    listed = ", ".join(f"CAST({b!r} AS DOUBLE)" for b in bounds)
    # One row: the brackets of every column.
    sketched = numbers.agg(
        *[F.expr(f"percentile_approx(`{c}`, array({listed}), {accuracy}) AS b{i}") for i, c in enumerate(columns)],
        *[F.expr(f"count(`{c}`) AS n{i}") for i, c in enumerate(columns)],
    ).first()
    asked = [
        (c, float(p), found[2 * i], found[2 * i + 1], rows)
        for c, found, rows in zip(columns, sketched, sketched[len(columns) :])
        if found
        for i, p in enumerate(probabilities)
    ]
    if not asked:
        return spark.createDataFrame([], _SCHEMA)
    asked = _narrowed(numbers, asked)

    # Each value falls below, inside or above each bracket of its column.
    placed = ", ".join(
        f"struct({slot} AS slot, CASE WHEN `{c}` < {_double(low)} THEN -1 WHEN `{c}` <= {_double(high)} THEN 0 "
        f"WHEN `{c}` > {_double(high)} THEN 1 END AS zone, `{c}` AS value)"
        for slot, (c, _, low, high) in enumerate(asked)
    )
    tallies = (
        numbers.selectExpr(f"inline(array({placed}))")
        .filter(F.col("zone").isNotNull())
        .groupBy("slot", "zone", F.when(F.col("zone") == 0, F.col("value")).alias("inside"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            # The neighbours just outside the bracket, needed when a quantile falls between two rows.
            F.max("value").alias("largest"),
            F.min("value").alias("smallest"),
        )
    )
    # The distinct values of one bracket: a fraction of a percent of the rows.
    upwards = Window.partitionBy("slot").orderBy("zone", "inside")
    everything = Window.partitionBy("slot")
    steps = tallies.withColumns(
        {"upto": F.sum("rows").over(upwards), "n": F.sum("rows").over(everything)}
    )
    slots = spark.createDataFrame(
        [(slot, c, p) for slot, (c, p, _, _) in enumerate(asked)],
        "slot int, column_name string, probability double",
    )
    place = (F.col("n") - 1) * F.col("probability")
    first, last = F.col("upto") - F.col("rows"), F.col("upto") - 1

    def at(rank):
        # Below a bracket only its largest value can be wanted, above it only the smallest.
        value = F.when(F.col("zone") < 0, F.col("largest")).otherwise(F.col("smallest"))
        return F.max(F.when(rank.between(first, last), value))

    # One row per asked quantile on the broadcast side.
    found = (
        steps.join(F.broadcast(slots), "slot")
        .groupBy("column_name", "probability")
        .agg(
            at(F.floor(place)).alias("left"),
            at(F.ceil(place)).alias("right"),
            F.max(place - F.floor(place)).alias("part"),
        )
    )
    value = F.col("left") + (F.col("right") - F.col("left")) * F.col("part")
    return found.select("column_name", "probability", value.alias("value"))


def _narrowed(numbers: DataFrame, asked: list[tuple]) -> list[tuple]:
    """column, probability, low, high of brackets that hold at most ``_BRACKET`` distinct values.

    A bracket of a sketch holds its margins and as much again as the sketch's error, of all rows or of the rows sketched.
    """
    share = 6.0 / _ACCURACY
    done = {i: a[:4] for i, a in enumerate(asked) if a[4] * share <= _BRACKET}
    wide = {i: a for i, a in enumerate(asked) if i not in done}
    while wide:
        inside = {i: f"`{c}` BETWEEN {_double(low)} AND {_double(high)}" for i, (c, _, low, high, _) in wide.items()}
        counts = numbers.selectExpr(
            *[f"count_if(`{c}` < {_double(low)}) AS b{i}" for i, (c, _, low, _, _) in wide.items()],
            *[f"count_if({test}) AS i{i}" for i, test in inside.items()],
        ).first()
        ranks = {}
        for i, (_, p, _, _, n) in wide.items():
            place, margin = (p * (n - 1) - counts[f"b{i}"]) / max(counts[f"i{i}"] - 1, 1), 2.0 / _ACCURACY
            ranks[i] = [min(max(place + d, 0.0), 1.0) for d in (-margin, margin)]
        cuts = numbers.selectExpr(
            *[
                f"percentile_approx(CASE WHEN {inside[i]} THEN `{a[0]}` END, array({ranks[i][0]!r}D, {ranks[i][1]!r}D), {_ACCURACY}) AS c{i}"
                for i, a in wide.items()
            ]
        ).first()
        for i, (c, p, low, high, n) in list(wide.items()):
            closer = (max(low, cuts[f"c{i}"][0]), min(high, cuts[f"c{i}"][1]))
            # One frequent value can be most of a bracket; then there is nothing left to narrow.
            if counts[f"i{i}"] * share <= _BRACKET or closer == (low, high):
                done[i] = (c, p, *closer)
                del wide[i]
            else:
                wide[i] = (c, p, *closer, n)
    return [done[i] for i in sorted(done)]


def _double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"
