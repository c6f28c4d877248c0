from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from creditloom.operators import attribution, neighbours, preparation, rules
from creditloom.operators.boosting import Inputs
from creditloom.operators.evaluation import roc_auc
from creditloom.plans import modelling

SMALL = modelling.BoostingSettings(rounds=8, learning_rate=0.3, max_depth=3, min_rows_per_leaf=10)


@pytest.fixture(scope="module")
def applicants(spark):
    """Default depends on one score; the other columns are noise."""
    rng = np.random.default_rng(7)
    ext, noise = rng.random(800), rng.random(800)
    risk = 3 * (1 - ext) + noise
    y = (risk >= np.quantile(risk, 0.85)).astype(int)
    data = [
        (int(i), int(y[i]), float(ext[i]), float(rng.integers(30, 300) * 1000), "MF"[int(rng.integers(2))], None if i % 7 == 0 else float(i % 50))
        for i in range(800)
    ]
    df = spark.createDataFrame(
        data, "SK_ID_CURR long, TARGET int, EXT_SOURCE_MEAN double, AMT_INCOME_TOTAL double, CODE_GENDER string, OWN_CAR_AGE double"
    )
    return df.cache()


@pytest.fixture(scope="module")
def model(applicants):
    return modelling.train(applicants, SMALL)


def test_training_separates_and_calibrates(model):
    facts = {r["metric"]: r["value"] for r in model.summary.collect()}
    assert facts["rows_trained"] == 800 and facts["n_features"] == 4
    assert facts["roc_auc"] > 0.9 and facts["average_precision"] > facts["base_rate"]
    assert 0 <= facts["operating_threshold"] <= 1
    curve = sorted((r["p_raw"], r["p"]) for r in model.test_scores.collect())
    assert all(a[1] <= b[1] for a, b in zip(curve, curve[1:]))
    assert all(0 <= p <= 1 for _, p in curve)


def test_scoring_aligns_any_table(spark, model, applicants):
    narrow = applicants.select("SK_ID_CURR", "EXT_SOURCE_MEAN").withColumn("UNKNOWN", F.lit(1))
    scores = model.score(narrow)
    assert scores.count() == 800 and "y" not in scores.columns
    ends = scores.join(applicants.select(F.col("SK_ID_CURR").alias("id"), "EXT_SOURCE_MEAN"), "id")
    low = ends.filter("EXT_SOURCE_MEAN < 0.1").agg(F.avg("p")).first()[0]
    high = ends.filter("EXT_SOURCE_MEAN > 0.9").agg(F.avg("p")).first()[0]
    assert low > high


def contributions(model, applicants):
    rows = modelling.shown_rows(applicants, model.inputs)
    return attribution.tree_contributions(rows, model.booster, "id", "shown"), rows


def test_contributions_add_up_to_the_log_odds(model, applicants):
    (pushes, base), rows = contributions(model, applicants)
    total = attribution.contribution_rows(pushes, "id").groupBy("id").agg(F.sum("contribution").alias("s"))
    worst = total.join(model.booster.margins(rows, ["id"]), "id").agg(F.max(F.abs(F.col("s") + base - F.col("margin")))).first()[0]
    assert worst < 1e-9


def test_contributions_match_the_definition(model, applicants):
    """Shapley values by enumerating every coalition on one applicant."""
    from itertools import combinations
    from math import factorial

    (pushes, _), rows = contributions(model, applicants)
    x = np.array([[np.nan if v is None else v for v in rows.filter("id = 7").first()["x"]]])
    bins = model.inputs.binned(x)[0]

    def worth(known, tree, node=0):
        feature = tree.feature[node]
        if feature < 0:
            return tree.value[node]
        children = tree.children[node]
        if feature in known:
            return worth(known, tree, children[0 if tree.left[node, bins[feature]] else 1])
        return sum(tree.rows[c] / tree.rows[node] * worth(known, tree, c) for c in children)

    d = len(bins)
    got = [r["contribution"] for r in attribution.contribution_rows(pushes.filter("id = 7"), "id").collect()]
    for j in range(d):
        others = [i for i in range(d) if i != j]
        expected = sum(
            factorial(size) * factorial(d - size - 1) / factorial(d) * (worth({*c, j}, tree) - worth(set(c), tree))
            for tree in model.booster.trees
            for size in range(d)
            for c in combinations(others, size)
        )
        assert got[j] == pytest.approx(expected, abs=1e-9)


def test_factors_show_what_was_given(model, applicants):
    (pushes, _), _ = contributions(model, applicants)
    shown = {(r["id"], r["feature"]): r["value"] for r in attribution.top_factors(pushes, "id", 4).collect()}
    raw = {r["SK_ID_CURR"]: r for r in applicants.collect()}
    for i in (0, 1, 7, 8):
        assert shown[i, "CODE_GENDER"] == raw[i]["CODE_GENDER"]
        age = raw[i]["OWN_CAR_AGE"]
        assert shown[i, "OWN_CAR_AGE"] == (None if age is None else str(age))


def test_the_real_driver_ranks_first(model, applicants):
    (pushes, _), _ = contributions(model, applicants)
    assert attribution.global_importance(pushes).first()["feature"] == "EXT_SOURCE_MEAN"
    factors = attribution.top_factors(pushes, "id", 2)
    assert factors.groupBy("id").count().filter("count <> 2").count() == 0
    safe = factors.join(applicants.select(F.col("SK_ID_CURR").alias("id"), "EXT_SOURCE_MEAN"), "id")
    driver = safe.filter("feature = 'EXT_SOURCE_MEAN' AND EXT_SOURCE_MEAN > 0.95 AND rank = 1")
    assert {r["direction"] for r in driver.collect()} == {"decreases_risk"}


def test_rules_partition_the_portfolio(spark):
    df = spark.range(200).select("id", (F.col("id") / 20.0).alias("SCORE_FEATURE"), (F.col("id") < 100).cast("int").alias("label"))
    df = df.withColumn("p", (10 - F.col("SCORE_FEATURE")) / 10)
    inputs = Inputs(["SCORE_FEATURE"], [[i / 20.0 for i in range(4, 199, 5)]], [None])
    rows = df.select("id", "label", F.col("p").alias("y"), F.array("SCORE_FEATURE").alias("x"))
    tree = rules.fit_surrogate(rows, inputs, max_depth=1, min_rows=20)
    conditions = rules.leaf_conditions(spark, tree)
    leaves = tree.leaves(rows, ["id", "label", "y"]).withColumnsRenamed({"y": "p", "label": "y"})
    table = rules.rule_table(leaves, conditions).collect()
    assert [r["observed_default_rate"] for r in table] == sorted((r["observed_default_rate"] for r in table), reverse=True)
    assert sum(r["n_applicants"] for r in table) == 200
    assert table[0]["observed_default_rate"] == pytest.approx(1.0) and table[-1]["observed_default_rate"] < 0.1
    assert table[0]["sentence"].startswith("IF Score feature <= ")
    assert table[0]["lift_over_base_rate"] == pytest.approx(2.0)
    assert rules.apply_predicates(df.join(leaves.select("id", "leaf"), "id"), conditions).filter("leaf <> rule_leaf").count() == 0


def test_rules_speak_of_raw_columns(spark):
    """Ranges, sets of categories, missing and unseen values: each predicate finds its leaf's rows in the raw table."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(3000):
        amount = None if i % 11 == 0 else float(rng.integers(0, 1000))
        kind = None if i % 13 == 0 else "it's XNA red blue green".split(" ")[int(rng.integers(0, 5))]
        flag = bool(rng.integers(0, 2)) if i % 7 else None
        risk = (amount is None) * 3 + (200 < (amount or 0) < 500) * 2 + (kind in ("XNA", "it's", None)) + 2 * bool(flag) * (kind == "red")
        data.append((i, int(rng.random() < risk / 8), amount, kind, flag))
    df = spark.createDataFrame(data, "SK_ID_CURR long, TARGET int, AMOUNT double, KIND string, FLAG boolean").cache()
    inputs = modelling.fit_tree_inputs(df.filter("coalesce(KIND, '') <> 'green'"))
    rows = modelling.prepared_rows(df, inputs)
    tree = rules.fit_surrogate(rows, inputs, max_depth=4, min_rows=100)
    conditions = rules.leaf_conditions(spark, tree, dict(df.dtypes))
    both = rules.apply_predicates(df, conditions).join(tree.leaves(rows, ["id"]), F.col("id") == F.col("SK_ID_CURR"))
    assert both.filter("NOT (leaf <=> rule_leaf)").count() == 0 and both.count() == 3000
    found = conditions.collect()
    assert len(found) > 4
    said = " / ".join(t for r in found for t in r["conditions"])
    assert "Kind in {" in said and "Amount > " in said and "missing" in said
    assert all(len({t.split(" ")[0] for t in r["conditions"]}) == len(r["conditions"]) for r in found)
    assert both.groupBy("leaf").count().agg(F.min("count")).first()[0] >= 100


def brute_force(x, k):
    away = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(away, np.inf)
    return np.sort(away, axis=1)[:, :k]


@pytest.mark.parametrize("case", ["spread", "copies", "few", "wide", "far"])
def test_neighbours_are_exact(spark, many_partitions, monkeypatch, case):
    """Many small cells, cells of copies, cells with fewer points than neighbours, many columns, large numbers."""
    monkeypatch.setattr(neighbours, "CELL", 23)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4 if case == "few" else 400, 3)) * [10, 1, 1]
    if case == "copies":
        x[:150] = x[0]
    if case == "wide":
        x = np.repeat(rng.normal(size=(40, 30)) * 20, 10, axis=0) + rng.normal(size=(400, 30))
    if case == "far":
        x = np.concatenate([x + 1e8, x[:7] * 1e5])[:400]
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    got = neighbours.nearest_neighbours(points, 5).collect()
    expected = brute_force(x, 5)
    per_id = {}
    for r in got:
        assert r["id"] != r["neighbour"]
        assert np.sqrt(((x[r["id"]] - x[r["neighbour"]]) ** 2).sum()) == pytest.approx(r["distance"])
        per_id.setdefault(r["id"], []).append(r["distance"])
    for i in range(len(x)):
        assert sorted(per_id[i]) == pytest.approx(list(expected[i][: len(x) - 1]))
        assert len({r["neighbour"] for r in got if r["id"] == i}) == len(per_id[i])


def test_synthetic_rows_lie_between_their_parents(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    made = neighbours.synthetic_rows(points, 97).collect()
    assert len(made) == 97
    nearest = {(r["id"], r["neighbour"]) for r in neighbours.nearest_neighbours(points).collect()}
    for r in made:
        assert (r["id"], r["neighbour"]) in nearest and 0 <= r["u"] < 1
        assert np.allclose(r["x"], x[r["id"]] + r["u"] * (x[r["neighbour"]] - x[r["id"]]))


def test_smote_balances_the_classes(spark):
    df = spark.range(100).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("x"))
    sizes = {r["y"]: r["count"] for r in neighbours.smote(df).groupBy("y").count().collect()}
    assert sizes == {0: 90, 1: 90}


def test_unseen_and_missing_categories(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    other = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    coded = preparation.encode_categoricals(other, preparation.fit_codes(train, ["c"]))
    assert [r["c_code"] for r in coded.collect()] == [0.0, 1.0, -1.0, -1.0]


def test_rare_categories_share_a_slot(spark):
    df = spark.createDataFrame([(f"c{i:02d}",) for i in range(25) for _ in range(i + 1)], "c string")
    groups = preparation.fit_frequent(df, ["c"])["c"]
    assert groups["rare"] == [f"c{i:02d}" for i in range(6)] and len(groups["frequent"]) == 19
    shown = df.limit(1).select(*[c.alias(n) for n, c in preparation.indicator_columns({"c": groups}).items()])
    assert len(shown.columns) == 20


def test_baseline_ranks_better_than_chance(applicants):
    model = modelling.fit_baseline(applicants, 30)
    scored = model.transform(applicants).select(F.col("TARGET").alias("y"), vector_to_array("probability")[1].alias("p"))
    assert roc_auc(scored).first()[0] > 0.9


def test_study_compares_all_strategies_on_the_same_folds(applicants):
    quick = modelling.BoostingSettings(rounds=2, learning_rate=0.3, max_depth=2, min_rows_per_leaf=10)
    scores = modelling.strategy_scores(applicants, quick).cache()
    per_fold = scores.groupBy("strategy", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("d")).collect()
    assert len(per_fold) == 20
    for fold in range(1, 6):
        assert len({(r["n"], r["d"]) for r in per_fold if r["fold"] == fold}) == 1
    summary = modelling.strategy_summary(modelling.fold_scores(scores, ["strategy", "fold"])).collect()
    chosen = [r for r in summary if r["chosen"]]
    assert len(chosen) == 1 and chosen[0]["mean_pr_auc"] == max(r["mean_pr_auc"] for r in summary)


def test_raw_applications_get_their_ratios(spark):
    columns = (
        "SK_ID_CURR long, TARGET int, AMT_CREDIT double, AMT_INCOME_TOTAL double, CREDIT_INCOME_RATIO double"
    )
    data = [(i, int(i % 100 >= 80), 1000.0 * (1 + i % 100), 1000.0, 1.0 + i % 100) for i in range(600)]
    model = modelling.train(spark.createDataFrame(data, columns), SMALL)
    raw = spark.createDataFrame([(1, 5000.0, 1000.0), (2, 95000.0, 1000.0)], "SK_ID_CURR long, AMT_CREDIT double, AMT_INCOME_TOTAL double")
    got = {r["id"]: r["p"] for r in model.score_applications(raw).collect()}
    assert got[2] > 0.5 > got[1]


def test_boosting_goes_on_while_early_stop_rows_improve(spark):
    i = F.col("id")
    noise = lambda a: (F.pmod(F.xxhash64("id", F.lit(a)), F.lit(1000)) / 1000.0)
    x = [noise(k) for k in range(4)]
    logit = 3 * F.sin(x[0] * 9) + 3 * F.sin(x[1] * 7) * x[2]
    df = spark.range(4000).select((i).alias("id"), (logit + noise(9) * 2 > 1.5).cast("int").alias("y"), F.array(*x).alias("x")).cache()
    inputs = Inputs([f"x{k}" for k in range(4)], [[v / 40 for v in range(1, 40)]] * 4, [None] * 4)
    settings = modelling.BoostingSettings(rounds=200, learning_rate=0.1, max_depth=3, min_rows_per_leaf=10, patience=20)
    fit, stop, judge = df.filter("id % 4 < 2"), df.filter("id % 4 = 2"), df.filter("id % 4 = 3")
    model, course = modelling.fit_boosted_trees(fit, stop, inputs, settings)
    assert 30 < len(model.trees) <= 200 and max(course) == course[len(model.trees) - 1]
    again, _ = modelling.fit_boosted_trees(fit, None, inputs, dataclasses.replace(settings, rounds=len(model.trees)))
    assert all((a.value == b.value).all() for a, b in zip(model.trees, again.trees))
    flat = VectorAssembler(inputCols=["x0", "x1", "x2", "x3"], outputCol="features").transform(
        df.select("id", "y", *[F.col("x")[k].alias(f"x{k}") for k in range(4)])
    )
    linear = LogisticRegression(labelCol="y").fit(flat.filter("id % 4 < 2")).transform(flat.filter("id % 4 = 3"))
    scores = [modelling.probabilities(model, judge), linear.select("id", "y", vector_to_array("probability")[1].alias("p"))]
    auc = [roc_auc(s).first()[0] for s in scores]
    assert auc[0] > auc[1] + 0.05


def test_a_saved_model_scores_as_the_fitted_one(spark, tmp_path):
    columns = "SK_ID_CURR long, TARGET int, AMT_CREDIT double, AMT_INCOME_TOTAL double, KIND string"
    data = [(i, int(i % 100 >= 80), 1000.0 * (1 + i % 100), 1000.0, "ab"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(data, columns)
    model = modelling.train(df, SMALL)
    folder = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        modelling.load_model(spark, folder)
    model.save(folder)
    again = modelling.load_model(spark, folder)
    assert sorted(map(tuple, again.score(df).collect())) == sorted(map(tuple, model.score(df).collect()))
    assert sorted(map(tuple, again.summary.collect())) == sorted(map(tuple, model.summary.collect()))
    assert again.test_scores.count() == model.test_scores.count()
