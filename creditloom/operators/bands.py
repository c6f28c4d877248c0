"""Risk bands: cut from the observed score distribution, then applied to any scored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import ratio
from creditloom.operators.evaluation import _riskiest_first

# The top tenth is High, the bottom half is Low.
BANDS = ("High", "Medium", "Low")


def risk_bands(scored: DataFrame, label: str = "y", score: str = "p", key: str = "id") -> DataFrame:
    """``band, score_threshold, applicants, population_share, default_rate, lift`` for the three bands.

    Bands are cut by position in the ranking, so equal scores at a cut may fall on both sides of it; the
    thresholds are the scores at the cuts, to four decimals.
    """
    ranked = _riskiest_first(scored, label, score, key)
    high_end = F.greatest(F.expr("n_total DIV 10"), F.lit(1).cast("long"))
    medium_end = F.expr("n_total DIV 2")
    position = F.col("position")
    banded = ranked.select(
        "y",
        F.when(position < high_end, 0).when(position < medium_end, 1).otherwise(2).alias("band_no"),
        # A cut before the first row means the last one, as counting from the end does.
        F.when(position == high_end - 1, F.col("p")).alias("high_cut"),
        F.when(position == F.pmod(medium_end - 1, F.col("n_total")), F.col("p")).alias("medium_cut"),
    )
    sums = banded.agg(
        F.count(F.lit(1)).alias("n_all"),
        F.sum("y").alias("pos_all"),
        F.max("high_cut").alias("high_cut"),
        F.max("medium_cut").alias("medium_cut"),
        *[F.count_if(F.col("band_no") == i).alias(f"n{i}") for i in range(3)],
        *[F.count_if((F.col("band_no") == i) & (F.col("y") == 1)).alias(f"pos{i}") for i in range(3)],
    ).filter("n_all > 0")
    cuts = (F.round("high_cut", 4), F.round("medium_cut", 4), F.lit(0.0))
    overall = F.col("pos_all") / F.col("n_all")

    def row(i: int) -> Column:
        rate = F.coalesce(ratio(f"pos{i}", f"n{i}"), F.lit(0.0))
        return F.struct(
            F.lit(BANDS[i]).alias("band"),
            cuts[i].alias("score_threshold"),
            F.col(f"n{i}").alias("applicants"),
            (F.col(f"n{i}") / F.col("n_all")).alias("population_share"),
            rate.alias("default_rate"),
            F.coalesce(ratio(rate, overall), F.lit(0.0)).alias("lift"),
            overall.alias("base_rate"),
        )

    return sums.select(F.inline(F.array(*[row(i) for i in range(3)])))


def apply_bands(scored: DataFrame, bands: DataFrame, score: str = "p") -> DataFrame:
    """Add band, the band's threshold, the base rate and the lift of each score over it.

    The three band rows become literals, so scoring a table of any size is a projection.
    """
    found = {r["band"]: r for r in bands.collect()}
    p, base = F.col(score), float(found["High"]["base_rate"])
    cut = {name: float(found[name]["score_threshold"]) for name in BANDS}

    def pick(high, medium, low) -> Column:
        return F.when(p >= cut["High"], high).when(p >= cut["Medium"], medium).otherwise(low)

    return scored.withColumns(
        {
            "band": pick(*BANDS),
            "band_threshold": pick(*[cut[name] for name in BANDS]),
            "base_rate": F.lit(base),
            "lift_over_base_rate": F.round(p / base, 2) if base else F.lit(0.0),
        }
    )


def with_outcome(banded: DataFrame, labelled: DataFrame, key: str = "id", label: str = "y") -> DataFrame:
    """Add the actual outcome where the applicant is labelled."""
    outcome = labelled.select(F.col(key), F.col(label).alias("actual_target"))
    return banded.drop(label).join(outcome, key, "left")
