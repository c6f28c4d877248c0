from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators import bands, evaluation
from tests.conftest import plan_of


def frame(spark, y, p):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id long, y int, p double")


def sample(n, seed, decimals=None):
    rng = np.random.default_rng(seed)
    p = rng.random(n) if decimals is None else np.round(rng.random(n), decimals)
    return (rng.random(n) < p * 0.3).astype(int), p


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > neg).mean() + (a == neg).mean() / 2 for a in pos])


def average_precision(y, p):
    total, gained = 0.0, 0
    for t in sorted(set(p), reverse=True):
        hits = y[p >= t].sum()
        total += (hits - gained) / y.sum() * hits / (p >= t).sum()
        gained = hits
    return total


def ks(y, p):
    return max(abs((p[y == 1] >= t).mean() - (p[y == 0] >= t).mean()) for t in set(p))


@pytest.mark.parametrize(("n", "decimals"), [(300, None), (400, 1), (997, 2)])
def test_ranking_metrics_match_brute_force(spark, many_partitions, n, decimals):
    y, p = sample(n, n, decimals)
    got = evaluation.ranking_metrics(frame(spark, y, p)).first()
    assert got["roc_auc"] == pytest.approx(auc(y, p))
    assert got["average_precision"] == pytest.approx(average_precision(y, p))
    assert got["ks_statistic"] == pytest.approx(ks(y, p))


def test_metrics_per_group_equal_metrics_of_each_group(spark, many_partitions):
    y, p = sample(500, 5, 2)
    df = frame(spark, y, p).withColumn("g", F.col("id") % 3)
    for r in evaluation.ranking_metrics(df, by=["g"]).collect():
        part = np.arange(500) % 3 == r["g"]
        assert r["roc_auc"] == pytest.approx(auc(y[part], p[part]))
        assert r["average_precision"] == pytest.approx(average_precision(y[part], p[part]))


def test_separation_extremes(spark):
    perfect = frame(spark, [0] * 50 + [1] * 50, [0.1] * 50 + [0.9] * 50)
    assert evaluation.ks_statistic(perfect).first()[0] == 1.0
    rng = random.Random(1)
    noise = frame(spark, [rng.random() < 0.5 for _ in range(20_000)], [rng.random() for _ in range(20_000)])
    assert evaluation.ks_statistic(noise).first()[0] < 0.03


def test_single_class_has_no_auc(spark):
    assert evaluation.roc_auc(frame(spark, [0, 0, 0], [0.1, 0.2, 0.3])).first()[0] is None


def test_confusion_and_precision(spark):
    df = frame(spark, [0, 0, 0, 1, 1, 1], [0.1, 0.2, 0.6, 0.3, 0.7, 0.9])
    assert evaluation.confusion_matrix(df, 0.5).first().asDict() == {
        "true_negative": 2, "false_positive": 1, "false_negative": 1, "true_positive": 2,
    }
    assert tuple(evaluation.precision_recall(df, 0.5).first()) == pytest.approx((2 / 3, 2 / 3))
    assert tuple(evaluation.precision_recall(df, 2.0).first()) == (0.0, 0.0)


@pytest.mark.parametrize("n", [7, 100, 997])
def test_lift_bins(spark, many_partitions, n):
    y, p = sample(n, 3 * n, 2)
    y[0] = 1
    got = sorted(evaluation.lift_table(frame(spark, y, p)).collect(), key=lambda r: r["decile"])
    order = sorted(range(n), key=lambda i: (-p[i], i))
    edges = [n * i // 10 for i in range(11)]
    assert [r["applicants"] for r in got] == list(np.diff(edges))
    for r in got:
        part = [y[i] for i in order[edges[r["decile"] - 1] : edges[r["decile"]]]]
        assert r["default_rate"] == pytest.approx(np.mean(part) if part else 0.0)
    assert got[-1]["cumulative_capture"] == 1.0
    assert sum(r["population_share"] for r in got) == pytest.approx(1.0)


def test_calibration_bins_are_quantiles(spark, many_partitions):
    y, p = sample(500, 9, 2)
    got = {r["bin"]: r for r in evaluation.calibration_curve(frame(spark, y, p)).collect()}
    edges = np.quantile(p, np.arange(1, 10) / 10)
    bins = np.searchsorted(edges, p) + 1
    assert set(got) == set(bins)
    for b, r in got.items():
        assert r["mean_predicted"] == pytest.approx(p[bins == b].mean())
        assert r["fraction_positive"] == pytest.approx(y[bins == b].mean())


@pytest.mark.parametrize("decimals", [None, 2])
def test_cost_threshold_matches_a_full_search(spark, decimals):
    y, p = sample(400, 21, decimals)
    best = (float("inf"), None)
    for t in np.unique(np.round(p, 4)):
        cost = 10.0 * ((p < t) & (y == 1)).sum() + ((p >= t) & (y == 0)).sum()
        best = min(best, (cost, t))
    got = evaluation.cost_threshold(frame(spark, y, p)).first()
    assert (got["cost"], got["threshold"]) == best


def roc_points(y, p, limit=200):
    """Corners of the curve, thinned evenly."""
    steps = [(0, 0)]
    for t in sorted(set(p), reverse=True):
        steps.append((int(((p >= t) & (y == 0)).sum()), int(((p >= t) & (y == 1)).sum())))
    inner = steps[1:]
    kept = [
        q
        for i, q in enumerate(inner)
        if i in (0, len(inner) - 1)
        or (inner[i + 1][0] - q[0], inner[i + 1][1] - q[1]) != (q[0] - inner[i - 1][0], q[1] - inner[i - 1][1])
    ]
    path = [(0, 0), *kept]
    if len(path) > limit:
        path = [path[j * (len(path) - 1) // (limit - 1)] for j in range(limit)]
    return path


@pytest.mark.parametrize(("n", "decimals"), [(60, 1), (1500, None)])
def test_roc_curve(spark, many_partitions, monkeypatch, n, decimals):
    orders = []
    stored = evaluation.stored_in_order
    monkeypatch.setattr(evaluation, "stored_in_order", lambda *a: orders.append(1) or stored(*a))
    y, p = sample(n, 4, decimals)
    got = sorted(evaluation.roc_curve(frame(spark, y, p)).collect(), key=lambda r: r["point"])
    expected = [(a / (y == 0).sum(), b / (y == 1).sum()) for a, b in roc_points(y, p)]
    assert len(got) == len(expected)
    assert np.allclose([(r["fpr"], r["tpr"]) for r in got], expected)
    assert len(got) <= 200 and len(orders) == 1
    assert "rangepartitioning" not in plan_of(evaluation.roc_curve(frame(spark, y, p)))


def test_bands_and_their_application(spark, many_partitions):
    y, p = sample(105, 8)
    df = frame(spark, y, p)
    cut = {r["band"]: r for r in bands.risk_bands(df).collect()}
    top = sorted(p, reverse=True)
    assert cut["High"]["applicants"] == 10 and cut["Medium"]["applicants"] == 42 and cut["Low"]["applicants"] == 53
    assert cut["High"]["score_threshold"] == pytest.approx(round(top[9], 4))
    assert cut["Medium"]["score_threshold"] == pytest.approx(round(top[51], 4))
    for r in bands.apply_bands(df, bands.risk_bands(df)).collect():
        expected = "High" if r["p"] >= cut["High"]["score_threshold"] else "Medium" if r["p"] >= cut["Medium"]["score_threshold"] else "Low"
        assert r["band"] == expected and r["band_threshold"] == cut[expected]["score_threshold"]


def test_outcome_is_known_for_labelled_applicants_only(spark):
    labelled = frame(spark, [1, 0], [0.9, 0.1])
    everyone = labelled.drop("y").unionByName(spark.createDataFrame([(50, 0.4)], "id long, p double"))
    got = {r["id"]: r["actual_target"] for r in bands.with_outcome(bands.apply_bands(everyone, bands.risk_bands(labelled)), labelled).collect()}
    assert got == {0: 1, 1: 0, 50: None}


def test_report_is_complete(spark):
    y, p = sample(200, 2)
    got = evaluation.evaluation_report(frame(spark, y, p)).collect()
    summary = {r["metric"] for r in got if r["section"] == "summary"}
    assert {"roc_auc", "average_precision", "ks_statistic", "brier_score", "base_rate", "threshold", "precision", "recall"} <= summary
    assert len({r["position"] for r in got if r["section"] == "lift"}) == 10
