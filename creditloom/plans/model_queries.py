"""Registered queries: model preparation, training, attribution and rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import attribution, preparation, rules, sampling
from creditloom.operators.application import ID, LABEL, with_derived_features
from creditloom.operators.bands import apply_bands, risk_bands
from creditloom.operators.feature_matrix import feature_matrix
from creditloom.operators.neighbours import synthetic_rows
from creditloom.plans import modelling
from creditloom.plans.evaluation_queries import scored
from creditloom.plans.registry import query
from creditloom.sources.intermediate import checkpoint_root, materialise

APP = "application_train"
CATEGORICAL = ["NAME_CONTRACT_TYPE", "CODE_GENDER", "NAME_EDUCATION_TYPE", "OCCUPATION_TYPE"]
NUMERIC = [
    "CNT_CHILDREN",
    "CNT_FAM_MEMBERS",
    "DAYS_BIRTH",
    "DAYS_EMPLOYED",
    "DAYS_REGISTRATION",
    "DAYS_ID_PUBLISH",
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "AMT_GOODS_PRICE",
    "EXT_SOURCE_1",
    "EXT_SOURCE_2",
    "EXT_SOURCE_3",
    "APARTMENTS_AVG",
]

SETTINGS = modelling.BoostingSettings()
# Twenty fits: larger steps and less patience, everything else as in a full run.
STUDY_SETTINGS = modelling.BoostingSettings(learning_rate=0.1, patience=20)


# Stored tables and trained models by application, data folder and source.
_kept: dict[tuple[str, ...], object] = {}


def forget() -> None:
    """Drop what earlier queries of this process have stored or trained."""
    _kept.clear()


def _once(t, what: str, build):
    key = (t.spark.conf.get("spark.app.id"), t.location, what)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def stored_matrix(t, source: str = APP) -> DataFrame:
    """The feature table, stored once per session and data folder; every fit reads the stored copy."""
    return _once(t, source, lambda: materialise(feature_matrix(t, source), "matrix"))


def trained(t) -> modelling.TrainedModel:
    return _once(t, "model", lambda: modelling.train(stored_matrix(t), SETTINGS))


def _training_rows(t) -> DataFrame:
    return sampling.assign_fold(t[APP]).filter(F.col("fold") != 1).drop("fold")


# --- preparation -------------------------------------------------------------------------------------------


@query("encode_categoricals")
def _encode_categoricals(t) -> DataFrame:
    """Fitted on four folds, applied to all rows of both application tables."""
    codes = preparation.fit_codes(_training_rows(t), CATEGORICAL)
    everyone = t[APP].select(ID, *CATEGORICAL).unionByName(t["application_test"].select(ID, *CATEGORICAL))
    return preparation.encode_categoricals(everyone, codes).select(ID, *codes.getOutputCols())


@query("impute_median")
def _impute_median(t) -> DataFrame:
    medians = preparation.fit_medians(_training_rows(t), NUMERIC)
    return preparation.impute(t[APP].select(ID, *NUMERIC), medians)


@query("impute_mode")
def _impute_mode(t) -> DataFrame:
    modes = preparation.fit_modes(_training_rows(t), CATEGORICAL)
    return preparation.impute(t[APP].select(ID, *CATEGORICAL), modes)


@query("standardize")
def _standardize(t) -> DataFrame:
    train = _training_rows(t)
    medians = preparation.fit_medians(train, NUMERIC)
    scaling = preparation.fit_scaling(preparation.impute(train, medians), NUMERIC)
    z = preparation.standardize(preparation.impute(t[APP].select(ID, *NUMERIC), medians), scaling)
    return z.select(ID, *[F.round(c, 6).alias(c) for c in NUMERIC])


@query("one_hot_top20")
def _one_hot_top20(t) -> DataFrame:
    """Also on a crossed category, which has more than twenty values."""
    crossed = F.concat_ws("/", "NAME_EDUCATION_TYPE", F.col("CNT_CHILDREN").cast("string"), "CODE_GENDER")
    train = t[APP].withColumn("SEGMENT", crossed)
    return preparation.one_hot_map(train, ["NAME_EDUCATION_TYPE", "CODE_GENDER", "SEGMENT"])


@query("smote_oversample")
def _smote_oversample(t) -> DataFrame:
    """New defaulted applicants on imputed numbers and coded categories, enough to match the others."""
    applicants = t[APP].select(ID, LABEL, *NUMERIC, *CATEGORICAL)
    inputs = modelling.fit_tree_inputs(applicants).as_numbers()
    numeric = [n for n, labels in zip(inputs.names, inputs.labels) if labels is None]
    rows = modelling.prepared_rows(applicants, inputs, preparation.fit_medians(applicants, numeric))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    minority = materialise(rows.filter("y = 1").select("id", "x"), "minority")
    made = synthetic_rows(minority, counts[0] - counts[1])
    return made.select("id", "copy", "neighbour", "u", *[F.col("x")[i].alias(c) for i, c in enumerate(inputs.names)])


# --- models ------------------------------------------------------------------------------------------------


@query("baseline_logistic")
def _baseline_logistic(t) -> DataFrame:
    scores = modelling.baseline_scores(stored_matrix(t))
    return modelling.fold_scores(materialise(scores, "baseline-scores"), ["fold"])


@query("gbt_model")
def _gbt_model(t) -> DataFrame:
    """Raw and calibrated probabilities of the applicants that no stage of training has seen."""
    return trained(t).test_scores


@query("isotonic_calibration")
def _isotonic_calibration(t) -> DataFrame:
    """The calibration map over the distinct raw scores of the test applicants."""
    return trained(t).test_scores.select("p_raw", "p").distinct()


@query("imbalance_study")
def _imbalance_study(t) -> DataFrame:
    scores = materialise(modelling.strategy_scores(stored_matrix(t), STUDY_SETTINGS), "study-scores")
    return modelling.strategy_summary(modelling.fold_scores(scores, ["strategy", "fold"]))


@query("training_summary")
def _training_summary(t) -> DataFrame:
    return trained(t).summary


@query("model_scored_portfolio")
def _model_scored_portfolio(t) -> DataFrame:
    """Unlabelled applicants scored by the trained model and put into the bands of its test scores."""
    model = trained(t)
    return apply_bands(model.score(stored_matrix(t, "application_test")), risk_bands(model.test_scores))


@query("reloaded_model_scores")
def _reloaded_model_scores(t) -> DataFrame:
    """Unlabelled applicants scored by the trained model after it was saved and loaded again."""
    folder = f"{checkpoint_root(t.spark)}/model-{uuid.uuid4().hex}"
    trained(t).save(folder)
    return modelling.load_model(t.spark, folder).score(stored_matrix(t, "application_test"))


# --- attribution -------------------------------------------------------------------------------------------

LINEAR_FEATURES = [
    "EXT_SOURCE_MEAN",
    "EXT_SOURCE_2",
    "CREDIT_INCOME_RATIO",
    "ANNUITY_INCOME_RATIO",
    "CREDIT_TERM",
    "AGE_YEARS",
    "YEARS_EMPLOYED",
    "CNT_CHILDREN",
]


def _linear(t) -> DataFrame:
    """Contributions of a linear score whose weights are the single-feature slopes of the default rate."""
    rows = with_derived_features(t[APP])
    fitted = rows.agg(
        *[F.avg(c).alias(f"m_{c}") for c in LINEAR_FEATURES],
        *[F.regr_slope(LABEL, c).alias(f"w_{c}") for c in LINEAR_FEATURES],
    ).first()
    weights = {c: fitted[f"w_{c}"] for c in LINEAR_FEATURES}
    means = {c: fitted[f"m_{c}"] for c in LINEAR_FEATURES}
    return attribution.linear_contributions(rows, weights, means, ID)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("contribution", F.round("contribution", 6))


@query("local_contributions")
def _local_contributions(t) -> DataFrame:
    return _rounded(attribution.contribution_rows(_linear(t), ID))


@query("top_n_per_row")
def _top_n_per_row(t) -> DataFrame:
    return _rounded(attribution.top_n_per_row(_linear(t), ID, 3))


@query("top_factors")
def _top_factors(t) -> DataFrame:
    return attribution.top_factors(_linear(t), ID)


@query("global_importance")
def _global_importance(t) -> DataFrame:
    ranked = attribution.global_importance(_linear(t))
    return ranked.withColumn("mean_abs_contribution", F.round("mean_abs_contribution", 6))


def _tree_pushes(t) -> tuple[DataFrame, float]:
    """Contributions with the raw values: names of categories, numbers as they were given, NULL where there was none."""
    model = trained(t)
    return attribution.tree_contributions(modelling.shown_rows(stored_matrix(t), model.inputs), model.booster, "id", "shown")


@query("tree_top_factors")
def _tree_top_factors(t) -> DataFrame:
    pushes, base = _tree_pushes(t)
    return attribution.top_factors(pushes, "id").withColumn("base_value", F.lit(base))


@query("tree_global_importance")
def _tree_global_importance(t) -> DataFrame:
    pushes, _ = _tree_pushes(t)
    return attribution.global_importance(pushes)


# --- rules -------------------------------------------------------------------------------------------------

_POLICY = [
    (0.0, ["Ext source mean <= 0.4", "Credit income ratio > 3"], "EXT_SOURCE_MEAN <= 0.4D AND CREDIT_INCOME_RATIO > 3D"),
    (1.0, ["Ext source mean <= 0.4"], "EXT_SOURCE_MEAN <= 0.4D"),
    (2.0, ["Ext source mean > 0.4", "Age years <= 40"], "EXT_SOURCE_MEAN > 0.4D AND AGE_YEARS <= 40D"),
    (3.0, [], "true"),
]


def _policy(t):
    """A written policy applied to every scored applicant; the first rule that holds wins."""
    conditions = t.spark.createDataFrame(_POLICY, "leaf double, conditions array<string>, predicate string")
    features = with_derived_features(t[APP].filter(F.col("EXT_SOURCE_2").isNotNull()))
    ruled = rules.apply_predicates(features, conditions).withColumns(
        {"y": F.col(LABEL), "p": F.lit(1.0) - F.col("EXT_SOURCE_2")}
    )
    return ruled, conditions


@query("rule_table")
def _rule_table(t) -> DataFrame:
    ruled, conditions = _policy(t)
    return rules.rule_table(ruled, conditions, leaf="rule_leaf")


@query("rule_fidelity")
def _rule_fidelity(t) -> DataFrame:
    """A cruder copy of the score, judged against the score itself."""
    return rules.rule_fidelity(scored(t).withColumn("surrogate", F.floor(F.col("p") * 4) / 4.0 + 0.125))


def _surrogate(t) -> tuple[DataFrame, DataFrame]:
    """Every applicant with leaf and fitted score of the surrogate, and the rules that its paths spell out."""

    def build():
        model, matrix = trained(t), stored_matrix(t)
        scores = model.score(matrix).select("id", F.col("y").alias("label"), "p")
        rows = modelling.prepared_rows(matrix, model.inputs).drop("y").join(scores, "id")
        rows = materialise(rows.withColumnRenamed("p", "y"), "surrogate-rows")
        tree = rules.fit_surrogate(rows, model.inputs)
        conditions = rules.leaf_conditions(t.spark, tree, dict(matrix.dtypes))
        leaves = tree.leaves(rows, ["id", "label", "y"]).withColumnsRenamed({"y": "p", "label": "y"})
        return materialise(leaves, "surrogate-leaves"), conditions

    return _once(t, "surrogate", build)


@query("surrogate_tree")
def _surrogate_tree(t) -> DataFrame:
    leaves, conditions = _surrogate(t)
    return rules.rule_table(leaves, conditions)


@query("rule_predicates")
def _rule_predicates(t) -> DataFrame:
    """Applicants per rule, once by the tree and once by the rule's text, applied to the raw feature table."""
    leaves, conditions = _surrogate(t)
    by_tree = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("by_tree"))
    ruled = rules.apply_predicates(stored_matrix(t), conditions)
    by_text = ruled.groupBy(F.col("rule_leaf").alias("leaf")).agg(F.count(F.lit(1)).alias("by_text"))
    return conditions.select("leaf", "predicate").join(by_tree, "leaf", "left").join(by_text, "leaf", "left")


@query("surrogate_fidelity")
def _surrogate_fidelity(t) -> DataFrame:
    """How well the rules' tree follows the calibrated score, and how both rank the outcomes."""
    leaves, _ = _surrogate(t)
    return rules.rule_fidelity(leaves, surrogate="fitted")
