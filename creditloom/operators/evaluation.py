"""Exact evaluation of scores against outcomes, distributed throughout.

Everything that depends on the order of the scores starts from the *score ladder*: one row per distinct score
with its counts and the counts above it. Equal scores collapse into one row, so ties need no tie-break, and
after calibration the ladder is short. Only quantities defined by row position (lift bins, bands) rank rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions import FINE_PLACES, exact_mean, exact_sum, ratio
from creditloom.operators.ordering import bin_of_position, block_totals, global_position, running_totals, stored_in_order, with_next

# Resolutions of sums of probabilities and of rates, whose addends never exceed one.

# Decimals of a candidate threshold and the costs of the two errors.
_THRESHOLD_STEPS = 1e4
FALSE_NEGATIVE_COST = 10.0
FALSE_POSITIVE_COST = 1.0

ROC_POINTS = 200


def _score_counts(scored: DataFrame, label: str, score: str) -> DataFrame:
    counts = {"n": F.count(F.lit(1)), "pos": F.sum(F.col(label).cast("long"))}
    return scored.groupBy(F.col(score).alias("score")).agg(*[c.alias(n) for n, c in counts.items()])


def score_ladder(scored: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """``score, n, pos`` per distinct score, highest first, with the counts above it and the totals."""
    return running_totals(_score_counts(scored, label, score), [F.col("score").desc()], ["n", "pos"])


def _cumulative() -> dict[str, Column]:
    pos_upto = F.col("pos_before") + F.col("pos")
    n_upto = F.col("n_before") + F.col("n")
    return {
        "tpr": ratio(pos_upto, "pos_total"),
        "fpr": ratio(n_upto - pos_upto, F.col("n_total") - F.col("pos_total")),
        "precision": pos_upto / n_upto,
    }


def _wide(count: Column) -> Column:
    return count.cast("decimal(18,0)")


def _roc_auc() -> Column:
    """Share of (positive, negative) pairs ranked correctly, ties counting half; NULL for a single class."""
    neg = F.col("n") - F.col("pos")
    neg_total = F.col("n_total") - F.col("pos_total")
    neg_below = neg_total - (F.col("n_before") - F.col("pos_before")) - neg
    # Twice the pairs won, which keeps the sum a whole number.
    won = F.sum(_wide(F.col("pos")) * (_wide(neg_below) * 2 + _wide(neg))).cast("double")
    pairs = F.max("pos_total").cast("double") * F.max(neg_total).cast("double")
    return won / F.nullif(pairs * 2, F.lit(0.0))


def _average_precision() -> Column:
    """Sum over distinct scores of the recall gained times the precision reached (a step function)."""
    return exact_sum(ratio("pos", "pos_total") * _cumulative()["precision"], FINE_PLACES)


def _ks() -> Column:
    """Largest distance between the score distributions of the two classes."""
    c = _cumulative()
    return F.max(F.abs(c["tpr"] - c["fpr"]))


def ladder_metric(ladder: DataFrame, **metrics: Column) -> DataFrame:
    return ladder.agg(*[c.alias(name) for name, c in metrics.items()])


def roc_auc(scored: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    return ladder_metric(score_ladder(scored, label, score), roc_auc=_roc_auc())


def average_precision(scored: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    return ladder_metric(score_ladder(scored, label, score), average_precision=_average_precision())


def ks_statistic(scored: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    return ladder_metric(score_ladder(scored, label, score), ks_statistic=_ks())


def ranking_metrics(scored: DataFrame, label: str = "y", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC, average precision and KS from one ladder, for all rows or per group.

    With ``by``, all groups share one ordering (group first, then score), from which each group's own start is
    subtracted; groups are expected to be few, such as the folds of a study.
    """
    metrics = {"roc_auc": _roc_auc(), "average_precision": _average_precision(), "ks_statistic": _ks()}
    if not by:
        return ladder_metric(score_ladder(scored, label, score), **metrics)
    counts = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    order = [*[F.col(c).asc() for c in by], F.col("score").desc()]
    ladder = running_totals(counts, order, ["n", "pos"])
    starts = ladder.groupBy(*by).agg(
        F.min("n_before").alias("n_start"),
        F.min("pos_before").alias("pos_start"),
        F.sum("n").alias("n_group"),
        F.sum("pos").alias("pos_group"),
    )
    own = ladder.join(starts, list(by)).withColumns(
        {
            "n_before": F.col("n_before") - F.col("n_start"),
            "pos_before": F.col("pos_before") - F.col("pos_start"),
            "n_total": F.col("n_group"),
            "pos_total": F.col("pos_group"),
        }
    )
    return own.groupBy(*by).agg(*[c.alias(name) for name, c in metrics.items()])


def average_precision_of_each(scored: DataFrame, by: Sequence[str], label: str = "y", score: str = "p") -> DataFrame:
    """Average precision per group, for many groups of bounded size: each is ordered within one task, after one shuffle."""
    counts = scored.repartition(*by).groupBy(*by, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    before = Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ladder = counts.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), zero) for c in ("n", "pos")})
    ladder = ladder.withColumn("pos_total", F.sum("pos").over(Window.partitionBy(*by)))
    return ladder.groupBy(*by).agg(_average_precision().alias("average_precision"))


def roc_curve(scored: DataFrame, label: str = "y", score: str = "p", points: int = ROC_POINTS) -> DataFrame:
    """``point, fpr, tpr`` from (0, 0) on, without points on a straight line, evenly thinned to ``points``."""
    # One stored order serves the counts, the neighbours and the numbering of the corners.
    ordered = stored_in_order(_score_counts(scored, label, score).withColumn("one", F.lit(1).cast("long")), [F.col("score").desc()])
    ladder = with_next(block_totals(ordered, ["n", "pos", "one"]), ["n", "pos"])
    # A point is a corner when the counts change from this score to the next.
    at_end = (F.col("one_before") == 0) | (F.col("one_before") == F.col("one_total") - 1)
    bends = (F.col("n") != F.col("next_n")) | (F.col("pos") != F.col("next_pos"))
    corner = F.coalesce(at_end | bends | (F.col("one_total") <= 2), F.lit(False))
    numbered = block_totals(ladder.withColumn("one", corner.cast("long")).drop("one_total", "one_before"), ["one"])
    kept = numbered.filter("one = 1").select("one_before", "one_total", *[c.alias(k) for k, c in _cumulative().items()])
    origin = (
        kept.agg(F.max("one_total").alias("one_total"))
        .filter(F.col("one_total").isNotNull())
        .select(
            F.lit(0).cast("long").alias("point"),
            F.lit(0.0).alias("fpr"),
            F.lit(0.0).alias("tpr"),
            "one_total",
        )
    )
    path = origin.unionByName(kept.select((F.col("one_before") + 1).alias("point"), "fpr", "tpr", "one_total"))
    # Point i stays when some j has floor(j * last / (points - 1)) = i; "last" is the number of corners.
    nearest = F.expr(f"(point * {points - 1} + one_total - 1) DIV one_total")
    chosen = F.floor(nearest * F.col("one_total") / (points - 1)) == F.col("point")
    return path.filter((F.col("one_total") < points) | chosen).select("point", "fpr", "tpr")


def brier_score(scored: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    return scored.agg(_brier(label, score).alias("brier_score"))


def _brier(label: str, score: str) -> Column:
    gap = F.col(score) - F.col(label)
    return exact_mean(gap * gap, FINE_PLACES)


def base_rate(scored: DataFrame, label: str = "y") -> DataFrame:
    return scored.agg(F.avg(label).alias("base_rate"))


def _confusion(threshold: float, label: str, score: str) -> dict[str, Column]:
    flagged, bad = F.col(score) >= F.lit(threshold), F.col(label) == 1
    return {
        "true_negative": F.count_if(~flagged & ~bad),
        "false_positive": F.count_if(flagged & ~bad),
        "false_negative": F.count_if(~flagged & bad),
        "true_positive": F.count_if(flagged & bad),
    }


def confusion_matrix(scored: DataFrame, threshold: float, label: str = "y", score: str = "p") -> DataFrame:
    return scored.agg(*[c.alias(k) for k, c in _confusion(threshold, label, score).items()])


def _precision_recall() -> dict[str, Column]:
    tp = F.col("true_positive")
    return {
        "precision": F.coalesce(ratio(tp, tp + F.col("false_positive")), F.lit(0.0)),
        "recall": F.coalesce(ratio(tp, tp + F.col("false_negative")), F.lit(0.0)),
    }


def precision_recall(scored: DataFrame, threshold: float, label: str = "y", score: str = "p") -> DataFrame:
    """Both are 0 when nothing was flagged, or nothing was bad."""
    counts = confusion_matrix(scored, threshold, label, score)
    return counts.select(*[c.alias(k) for k, c in _precision_recall().items()])


def _riskiest_first(scored: DataFrame, label: str, score: str, key: str) -> DataFrame:
    rows = scored.select(key, F.col(label).cast("long").alias("y"), F.col(score).alias("p"))
    return global_position(rows, [F.col("p").desc(), F.col(key).asc()])


def lift_table(
    scored: DataFrame, bins: int = 10, label: str = "y", score: str = "p", key: str = "id"
) -> DataFrame:
    """Gains by equal-sized bins of rows, riskiest first; bins without rows report zeros."""
    ranked = _riskiest_first(scored, label, score, key)
    per_bin = ranked.groupBy(bin_of_position(bins).alias("decile")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")
    )
    slots = scored.sparkSession.range(1, bins + 1).withColumnRenamed("id", "decile")
    zero = F.lit(0).cast("long")
    full = slots.join(per_bin, "decile", "left").withColumns(
        {"n": F.coalesce("n", zero), "pos": F.coalesce("pos", zero)}
    )
    # These windows see one row per bin.
    so_far = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = full.withColumns(
        {
            "n_all": F.sum("n").over(everything),
            "pos_all": F.sum("pos").over(everything),
            "pos_upto": F.sum("pos").over(so_far),
        }
    )
    rate = F.col("pos") / F.greatest(F.col("n"), F.lit(1).cast("long"))
    overall = ratio("pos_all", "n_all")
    return totals.select(
        "decile",
        F.col("n").alias("applicants"),
        F.coalesce(ratio("n", "n_all"), F.lit(0.0)).alias("population_share"),
        rate.alias("default_rate"),
        F.coalesce(ratio(rate, overall), F.lit(0.0)).alias("lift"),
        F.col("pos_upto").alias("cumulative_defaults"),
        (F.col("pos_upto") / F.greatest(F.col("pos_all"), F.lit(1).cast("long"))).alias("cumulative_capture"),
    )


def cumulative_gains(scored: DataFrame, bins: int = 10, label: str = "y", score: str = "p", key: str = "id") -> DataFrame:
    """Running defaults caught and their share, by bin."""
    return lift_table(scored, bins, label, score, key).select(
        "decile", "cumulative_defaults", "cumulative_capture"
    )


def quantile_edges(ladder: DataFrame, bins: int) -> list[float]:
    """Inner edges of equal-count bins by linear interpolation, read off the ladder (``bins - 1`` numbers)."""
    lowest = F.col("n_total") - F.col("n_before") - F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((lowest <= rank) & (rank < lowest + F.col("n")), F.col("score")))

    places = [(F.col("n_total") - 1) * i / F.lit(float(bins)) for i in range(1, bins)]
    wanted = []
    for place in places:
        wanted += [at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))]
    row = ladder.agg(*[c.alias(f"c{i}") for i, c in enumerate(wanted)]).first()
    if row[0] is None:
        return []
    return [row[i] + (row[i + 1] - row[i]) * row[i + 2] for i in range(0, len(wanted), 3)]


def calibration_curve(scored: DataFrame, bins: int = 10, label: str = "y", score: str = "p") -> DataFrame:
    """Mean predicted against observed rate in equal-count bins; empty bins do not appear."""
    edges = quantile_edges(score_ladder(scored, label, score), bins)
    return _calibration(scored, edges, label, score)


def _calibration(scored: DataFrame, edges: list[float], label: str, score: str) -> DataFrame:
    above = [(F.lit(e) < F.col(score)).cast("int") for e in edges] or [F.lit(0)]
    return (
        scored.groupBy((reduce(Column.__add__, above) + 1).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("applicants"),
            exact_mean(score, FINE_PLACES).alias("mean_predicted"),
            F.avg(label).alias("fraction_positive"),
        )
    )


def cost_threshold(
    scored: DataFrame,
    fn_cost: float = FALSE_NEGATIVE_COST,
    fp_cost: float = FALSE_POSITIVE_COST,
    label: str = "y",
    score: str = "p",
) -> DataFrame:
    """The candidate threshold with the lowest cost; equal costs go to the lowest threshold.

    Candidates are the scores rounded to four decimals, but they are compared with the unrounded scores. All
    of them lie on a grid of 10,001 values, and a score passes exactly the candidates up to its own grid cell,
    so one histogram of grid cells answers for every candidate.
    """
    step = F.lit(_THRESHOLD_STEPS)
    p = F.col(score)
    guess = F.floor(p * step)
    # The product may round across a grid line; compare with the lines themselves.
    cell = F.when((guess + 1) / step <= p, guess + 1).when(guess / step > p, guess - 1).otherwise(guess)
    events = scored.select(
        F.inline(
            F.array(
                F.struct(
                    cell.cast("long").alias("grid"),
                    F.lit(1).cast("long").alias("n"),
                    F.col(label).cast("long").alias("pos"),
                    F.lit(0).alias("candidate"),
                ),
                F.struct(
                    F.rint(p * step).cast("long").alias("grid"),
                    F.lit(0).cast("long").alias("n"),
                    F.lit(0).cast("long").alias("pos"),
                    F.lit(1).alias("candidate"),
                ),
            )
        )
    )
    cells = events.groupBy("grid").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("candidate").alias("candidate")
    )
    # At most 10,001 cells for probabilities, whatever the number of rows.
    from_top = Window.orderBy(F.desc("grid")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.desc("grid")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    flagged = cells.withColumns(
        {
            "n_flagged": F.sum("n").over(from_top),
            "pos_flagged": F.sum("pos").over(from_top),
            "pos_all": F.sum("pos").over(everything),
        }
    )
    judged = flagged.filter(F.col("candidate") == 1).select(
        (F.col("grid") / step).alias("threshold"),
        (F.col("pos_all") - F.col("pos_flagged")).alias("fn"),
        (F.col("n_flagged") - F.col("pos_flagged")).alias("fp"),
    )
    costed = judged.withColumn("cost", F.col("fn") * F.lit(fn_cost) + F.col("fp") * F.lit(fp_cost))
    best = F.min(F.struct("cost", "threshold", "fn", "fp"))
    return costed.agg(best.alias("best")).select("best.threshold", "best.cost", "best.fn", "best.fp")


def evaluation_report(
    scored: DataFrame, threshold: float | None = None, label: str = "y", score: str = "p", key: str = "id"
) -> DataFrame:
    """Every metric as rows ``(section, position, metric, value)``; the cost threshold is used unless one is given."""
    if threshold is None:
        threshold = cost_threshold(scored, label=label, score=score).first()["threshold"]
    ladder = score_ladder(scored, label, score)
    ranking = ladder_metric(
        ladder, roc_auc=_roc_auc(), average_precision=_average_precision(), ks_statistic=_ks()
    )
    plain = scored.agg(
        _brier(label, score).alias("brier_score"),
        F.avg(label).alias("base_rate"),
        *[c.alias(k) for k, c in _confusion(threshold, label, score).items()],
    ).withColumns(_precision_recall() | {"threshold": F.lit(float(threshold))})
    lift = lift_table(scored, 10, label, score, key)
    calibration = _calibration(scored, quantile_edges(ladder, 10), label, score)
    return reduce(
        DataFrame.unionByName,
        [
            _long(ranking, "summary", F.lit(0)),
            _long(plain, "summary", F.lit(0)),
            _long(lift, "lift", F.col("decile"), drop="decile"),
            _long(calibration, "calibration", F.col("bin"), drop="bin"),
        ],
    )


def _long(df: DataFrame, section: str, position: Column, drop: str | None = None) -> DataFrame:
    metrics = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in df.columns
        if c != drop
    ]
    return df.select(
        F.lit(section).alias("section"), position.cast("long").alias("position"), F.inline(F.array(*metrics))
    )
