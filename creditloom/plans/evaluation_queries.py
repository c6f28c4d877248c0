"""Registered queries: metrics, bands and scoring on the deterministic score ``1 - EXT_SOURCE_2``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import bands, evaluation
from creditloom.operators.application import ID, LABEL
from creditloom.plans.registry import query

THRESHOLD = 0.6


def scored(t, tied: bool = False, source: str = "application_train") -> DataFrame:
    """``id, y, p``; the tied variant keeps two decimals, so that many scores are equal."""
    p = F.lit(1.0) - F.col("EXT_SOURCE_2")
    p = F.floor(p * 100) / F.lit(100.0) if tied else p
    known = t[source].filter(F.col("EXT_SOURCE_2").isNotNull())
    label = [F.col(LABEL).alias("y")] if LABEL in known.columns else []
    return known.select(F.col(ID).alias("id"), *label, p.alias("p"))


def _both(t, metric) -> DataFrame:
    """A one-row metric on the distinct and on the tied scores."""
    plain = metric(scored(t)).withColumn("scores", F.lit("distinct"))
    return plain.unionByName(metric(scored(t, tied=True)).withColumn("scores", F.lit("tied")))


for _name, _metric in {
    "roc_auc": evaluation.roc_auc,
    "average_precision": evaluation.average_precision,
    "ks_statistic": evaluation.ks_statistic,
    "brier_score": evaluation.brier_score,
    "base_rate": evaluation.base_rate,
    "cost_threshold": evaluation.cost_threshold,
    "roc_curve": evaluation.roc_curve,
    "lift_table": evaluation.lift_table,
    "cumulative_gains": evaluation.cumulative_gains,
    "calibration_curve": evaluation.calibration_curve,
    "confusion_matrix": lambda s: evaluation.confusion_matrix(s, THRESHOLD),
    "precision_recall_at_threshold": lambda s: evaluation.precision_recall(s, THRESHOLD),
    "risk_bands": bands.risk_bands,
}.items():
    query(_name)(lambda t, metric=_metric: _both(t, metric))


@query("evaluation_report")
def _evaluation_report(t) -> DataFrame:
    return evaluation.evaluation_report(scored(t))


@query("score_portfolio")
def _score_portfolio(t) -> DataFrame:
    """Bands cut on the labelled portfolio, applied to the unlabelled one."""
    return bands.apply_bands(scored(t, source="application_test"), bands.risk_bands(scored(t)))


@query("score_with_outcome")
def _score_with_outcome(t) -> DataFrame:
    """Both portfolios scored; the outcome is known for the labelled one only."""
    everyone = scored(t).drop("y").unionByName(scored(t, source="application_test"))
    banded = bands.apply_bands(everyone, bands.risk_bands(scored(t)))
    return bands.with_outcome(banded, scored(t))
