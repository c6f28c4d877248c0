"""Model pipelines: preparation, baseline, boosted trees, calibration, the imbalance study.

Only what a model has learned reaches the driver. Feature rows stay distributed.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditloom.functions import FINE_PLACES, exact_mean
from creditloom.operators import preparation, sampling
from creditloom.operators.application import ID, LABEL, derived_columns
from creditloom.operators.boosting import HELD_ROWS, BoostedTrees, Fit, Growth, Inputs, fit_boosting, fit_side_by_side, tree_columns, tree_of
from creditloom.operators.evaluation import cost_threshold, ranking_metrics
from creditloom.operators.feature_matrix import model_inputs
from creditloom.operators.neighbours import smote
from creditloom.sources.intermediate import materialise

FOLDS = 5


# Rank resolution of the sketch that proposes cut points; any cut points are right, these are near the quantiles.
_CUT_ACCURACY = 2000


@dataclass(frozen=True)
class BoostingSettings:
    """Boosting parameters; the defaults are the fixed values of a full training run."""

    rounds: int = 2000
    learning_rate: float = 0.03
    max_leaves: int = 31
    #: 0 for no limit
    max_depth: int = 0
    min_rows_per_leaf: int = 50
    l1: float = 0.1
    l2: float = 0.1
    row_share: float = 0.8
    feature_share: float = 0.8
    max_bins: int = 64
    seed: int = 42
    #: rounds without a better average precision on the early-stop rows after which training ends
    patience: int = 100

    @property
    def growth(self) -> Growth:
        return Growth(self.max_leaves, self.max_depth, self.min_rows_per_leaf, self.l1, self.l2)


# --- preparation as pipeline stages ------------------------------------------------------------------------


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "''")
    return f"'{escaped}'"


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _adding(expressions: Mapping[str, str]) -> SQLTransformer:
    listed = ", ".join(f"{sql} AS `{name}`" for name, sql in expressions.items())
    return SQLTransformer(statement=f"SELECT *, {listed} FROM __THIS__")


def align_to_features(df: DataFrame, like: DataFrame, keep: Sequence[str] = (ID, LABEL)) -> DataFrame:
    """Exactly the columns of ``like``: unknown ones are dropped, missing ones become NULL."""
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in like.schema.fields
        if f.name in df.columns or f.name not in keep
    ]
    return df.select(*columns)


def fit_tree_inputs(train: DataFrame, max_bins: int = BoostingSettings.max_bins) -> Inputs:
    """Cut points of the numbers and labels of the categories, both bounded by ``max_bins``.

    Numbers are cut near their quantiles; of the categories the most frequent have a bin of their own and the others share
    one. What the driver sees is bounded by the number of columns.
    """
    numeric, categorical = model_inputs(train)
    shares = ", ".join(f"{i / (max_bins - 2)!r}D" for i in range(max_bins - 1))
    cuts: dict[str, list[float]] = {}
    if numeric:
        found = train.selectExpr(
            *[f"percentile_approx(nullif(CAST(`{c}` AS DOUBLE), double('NaN')), array({shares}), {_CUT_ACCURACY}) AS `{c}`" for c in numeric]
        ).first()
        # What exceeds the last cut needs none above it.
        cuts = {c: sorted(set(found[c] or []))[:-1] for c in numeric}
    labels: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        by_rows = Window.partitionBy("column_name").orderBy(F.desc("rows"), "category")
        counted = preparation.category_counts(train, categorical).withColumn("place", F.row_number().over(by_rows))
        for r in counted.filter(F.col("place") <= max_bins - 2).orderBy("column_name", "category").collect():
            labels[r["column_name"]].append(r["category"])
    names = [*numeric, *categorical]
    return Inputs(names, [cuts.get(n) for n in names], [labels.get(n) for n in names])


def prepared_rows(matrix: DataFrame, inputs: Inputs, filled: Mapping[str, float] | None = None) -> DataFrame:
    """``id, y, x`` (the label where there is one); ``filled`` are values for missing numbers, which else stay missing."""
    label = [f"CAST(`{LABEL}` AS INT) AS y"] if LABEL in matrix.columns else []
    return matrix.selectExpr(f"`{ID}` AS id", *label, f"array({', '.join(inputs.columns(filled))}) AS x")


def shown_rows(matrix: DataFrame, inputs: Inputs) -> DataFrame:
    """``id, x, shown``: the inputs, and their raw values as a reader should see them (two decimals, categories by name)."""
    kinds = dict(matrix.dtypes)
    shown = [
        f"CAST(round(nullif(`{c}`, double('NaN')), 2) AS STRING)" if kinds[c] in ("double", "float") else f"CAST(`{c}` AS STRING)"
        for c in inputs.names
    ]
    return matrix.selectExpr(f"`{ID}` AS id", f"array({', '.join(inputs.columns())}) AS x", f"array({', '.join(shown)}) AS shown")


# --- models ------------------------------------------------------------------------------------------------


def fit_boosted_trees(
    train: DataFrame,
    early_stop: DataFrame | None,
    inputs: Inputs,
    settings: BoostingSettings,
    weight: float | None = None,
) -> tuple[BoostedTrees, list[float]]:
    """Boosted trees on ``id, y, x``, as many rounds as the early-stop rows' average precision calls for, and its course.

    Training ends when the best round lies ``patience`` rounds back; the trees up to the best round are kept. Without
    early-stop rows all rounds are kept.
    """
    return fit_boosting(
        train, early_stop, inputs, settings.growth, settings.rounds, settings.learning_rate, settings.patience,
        settings.row_share, settings.feature_share, weight, settings.seed,
    )


def probabilities(model: BoostedTrees, rows: DataFrame) -> DataFrame:
    """``id, y, p``."""
    kept = [c for c in ("id", "y") if c in rows.columns]
    return model.margins(rows, kept).select(*kept, (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))).alias("p"))


def fit_isotonic(scored: DataFrame) -> IsotonicRegressionModel:
    """Monotone map from raw score to probability; equal scores are pooled before fitting."""
    pooled = scored.groupBy("p").agg(F.avg("y").alias("rate"), F.count(F.lit(1)).cast("double").alias("w"))
    return IsotonicRegression(
        featuresCol="p", labelCol="rate", weightCol="w", predictionCol="calibrated", isotonic=True
    ).fit(pooled)


def calibrate(scored: DataFrame, model: IsotonicRegressionModel) -> DataFrame:
    """Replace ``p`` by the calibrated probability and keep the raw one as ``p_raw``."""
    mapped = model.transform(scored).withColumnRenamed("p", "p_raw")
    return mapped.withColumnRenamed("calibrated", "p")


def fit_baseline(train: DataFrame, max_iter: int = 1000) -> PipelineModel:
    """Median, scaling and capped one-hot columns into a class-balanced logistic regression."""
    numeric, categorical = model_inputs(train)
    medians = preparation.fit_medians(train, numeric)
    filled = train.selectExpr(*[f"coalesce(CAST(`{c}` AS DOUBLE), {_number(medians[c])}) AS `{c}`" for c in numeric])
    scaling = preparation.fit_scaling(filled, numeric)
    columns = {
        f"z_{c}": f"(coalesce(CAST(`{c}` AS DOUBLE), {_number(medians[c])}) - {_number(scaling[c][0])})"
        f" / {_number(scaling[c][1])}"
        for c in numeric
    }
    stages = []
    if categorical:
        modes = preparation.fit_modes(train, categorical)
        filled_names = {c: f"cat_{c}" for c in categorical if c in modes}
        stages.append(
            _adding({new: f"coalesce(`{c}`, {_literal(modes[c])})" for c, new in filled_names.items()})
        )
        imputed = preparation.impute(train, {c: modes[c] for c in filled_names})
        vocabulary = preparation.fit_frequent(imputed, list(filled_names))
        for c, groups in vocabulary.items():
            for i, category in enumerate(groups["frequent"]):
                columns[f"is_{c}_{i}"] = f"CAST(`cat_{c}` = {_literal(category)} AS DOUBLE)"
            if groups["rare"]:
                listed = ", ".join(_literal(v) for v in groups["rare"])
                columns[f"is_{c}_rare"] = f"CAST(`cat_{c}` IN ({listed}) AS DOUBLE)"
    stages += [_adding(columns), VectorAssembler(inputCols=list(columns), outputCol="features")]
    inputs = PipelineModel(stages)
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("pos")).first()
    n, pos = counts["n"], counts["pos"]
    # Both classes weigh half of the rows.
    balanced = F.when(F.col(LABEL) == 1, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(n - pos, 1)))
    rows = inputs.transform(train).select(F.col(LABEL).alias("y"), "features", balanced.alias("w"))
    # The penalty of one half of the squared weights against the summed loss, per row.
    model = LogisticRegression(
        labelCol="y", weightCol="w", maxIter=max_iter, regParam=1.0 / n, standardization=False
    ).fit(rows)
    return PipelineModel([*stages, model])


def _in_parallel(spark: SparkSession, jobs, parallelism: int):
    """Independent fits side by side, as Spark's own cross-validation runs them."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs))


def _with_fold(matrix: DataFrame) -> DataFrame:
    """Stored with its folds: every fit filters on the stored fold."""
    return materialise(sampling.assign_fold(matrix, FOLDS), "folds")


def baseline_scores(matrix: DataFrame, max_iter: int = 1000, parallelism: int = 8) -> DataFrame:
    """``fold, id, y, p``: every row scored by the model that did not see its fold."""
    folded = _with_fold(matrix)

    def job(fold: int):
        def run() -> DataFrame:
            train = folded.filter(F.col("fold") != fold).drop("fold")
            model = fit_baseline(train, max_iter)
            held_out = model.transform(folded.filter(F.col("fold") == fold))
            return held_out.select(
                F.lit(fold).alias("fold"),
                F.col(ID).alias("id"),
                F.col(LABEL).alias("y"),
                vector_to_array("probability")[1].alias("p"),
            )

        return run

    parts = _in_parallel(matrix.sparkSession, [job(f) for f in range(1, FOLDS + 1)], parallelism)
    return reduce(DataFrame.unionByName, parts)


STRATEGIES = ("none", "scale_pos_weight", "smote", "undersample")


def strategy_scores(
    matrix: DataFrame,
    settings: BoostingSettings,
    strategies: Sequence[str] = STRATEGIES,
    parallelism: int = 8,
) -> DataFrame:
    """``strategy, fold, id, y, p`` for every strategy on the same folds.

    Preparation is fitted on the training folds only; the held-out fold also stops the rounds early, as it does
    in the study this reproduces. Resampling touches training rows only.
    """
    folded = _with_fold(matrix)
    pos_weight = sampling.positive_weight(matrix)

    def prepare(fold: int):
        def run() -> dict[bool, tuple[Inputs, DataFrame, DataFrame]]:
            train = folded.filter(F.col("fold") != fold).drop("fold")
            held_out = folded.filter(F.col("fold") == fold)
            inputs = fit_tree_inputs(train, settings.max_bins)
            found = {}
            for interpolated in {s == "smote" for s in strategies}:
                own, rows, judged = _training_rows(train, held_out, inputs, interpolated)
                found[interpolated] = (own, materialise(rows, "fold-train"), materialise(judged, "fold-held-out"))
            return found

        return run

    folds = dict(
        zip(range(1, FOLDS + 1), _in_parallel(matrix.sparkSession, [prepare(f) for f in range(1, FOLDS + 1)], parallelism))
    )

    def resample(strategy: str, fold: int):
        def run() -> Fit:
            inputs, train, held_out = folds[fold][strategy == "smote"]
            if strategy in ("smote", "undersample"):
                train = materialise(resampled(train, strategy), "resampled")
            return Fit(train, held_out, inputs, pos_weight if strategy == "scale_pos_weight" else None)

        return run

    asked = [(s, f) for f in folds for s in strategies]
    fits = _in_parallel(matrix.sparkSession, [resample(*a) for a in asked], parallelism)
    scores = [
        probabilities(model, fit.judged).select(F.lit(strategy).alias("strategy"), F.lit(fold).alias("fold"), "id", "y", "p")
        for (strategy, fold), fit, model in zip(asked, fits, _fitted(fits, settings, parallelism))
    ]
    return reduce(DataFrame.unionByName, scores)


def _fitted(fits: Sequence[Fit], settings: BoostingSettings, parallelism: int) -> list[BoostedTrees]:
    """A model for each fit; those whose rows one task holds grow in the same jobs."""
    sizes = [rows.select(F.lit(i).alias("fit"), F.lit(kind).alias("kind")) for i, f in enumerate(fits) for kind, rows in enumerate((f.train, f.judged))]
    counts = reduce(DataFrame.unionByName, sizes).groupBy("fit", "kind").count().groupBy("fit").agg(F.max("count").alias("most"))
    most = {r["fit"]: r["most"] for r in counts.collect()}
    held = [i for i in range(len(fits)) if most.get(i, 0) <= HELD_ROWS]
    models: dict[int, BoostedTrees] = {}
    if held:
        found = fit_side_by_side(
            [fits[i] for i in held], settings.growth, settings.rounds, settings.learning_rate, settings.patience,
            settings.row_share, settings.feature_share, settings.seed,
        )
        models = {i: model for i, (model, _) in zip(held, found)}
    large = [i for i in range(len(fits)) if i not in models]
    alone = lambda f: lambda: fit_boosted_trees(f.train, f.judged, f.inputs, settings, f.weight)[0]
    models |= zip(large, _in_parallel(fits[0].train.sparkSession, [alone(fits[i]) for i in large], parallelism)) if large else ()
    return [models[i] for i in range(len(fits))]


def _training_rows(train: DataFrame, judged: DataFrame, inputs: Inputs, interpolated: bool) -> tuple[Inputs, DataFrame, DataFrame]:
    """The inputs as a strategy needs them, and both tables as ``id, y, x``.

    Rows that will be interpolated have categories as numbers and medians for missing numbers; the judged rows then have
    the same numbers for categories, but their missing numbers stay missing.
    """
    if not interpolated:
        return inputs, prepared_rows(train, inputs), prepared_rows(judged, inputs)
    coded = inputs.as_numbers()
    numeric, _ = model_inputs(train)
    return coded, prepared_rows(train, coded, preparation.fit_medians(train, numeric)), prepared_rows(judged, coded)


def resampled(train: DataFrame, strategy: str) -> DataFrame:
    """Training rows ``id, y, x`` after the strategy's resampling."""
    if strategy == "undersample":
        return sampling.undersample_majority(train, key="id", label="y")
    if strategy == "smote":
        return smote(train.select("id", "y", "x"))
    return train


def fold_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC-AUC, average precision and Brier score per group."""
    gap = F.col("p") - F.col("y")
    brier = scores.groupBy(*by).agg(exact_mean(gap * gap, FINE_PLACES).alias("brier"))
    return ranking_metrics(scores, by=by).drop("ks_statistic").join(brier, list(by))


def strategy_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation per strategy; the highest mean average precision is chosen."""
    means = folds.groupBy("strategy").agg(
        F.avg("average_precision").alias("mean_pr_auc"),
        F.stddev_pop("average_precision").alias("std_pr_auc"),
        F.avg("roc_auc").alias("mean_roc_auc"),
        F.avg("brier").alias("mean_brier"),
    )
    # One row per strategy on the left, one row on the right.
    best = means.agg(F.max_by("strategy", F.struct("mean_pr_auc", "strategy")).alias("winner"))
    return (
        means.withColumn("k", F.lit(1))
        .join(best.withColumn("k", F.lit(1)), "k")
        .select(*means.columns, (F.col("strategy") == F.col("winner")).alias("chosen"))
    )


# --- the whole training run --------------------------------------------------------------------------------


@dataclass(frozen=True)
class TrainedModel:
    booster: BoostedTrees
    calibrator: IsotonicRegressionModel
    features: DataFrame
    test_scores: DataFrame
    summary: DataFrame

    @property
    def inputs(self) -> Inputs:
        return self.booster.inputs

    def score(self, matrix: DataFrame) -> DataFrame:
        """``id, y, p, p_raw`` for any feature table."""
        aligned = align_to_features(matrix, self.features)
        return calibrate(probabilities(self.booster, prepared_rows(aligned, self.inputs)), self.calibrator)

    def score_applications(self, applications: DataFrame) -> DataFrame:
        """Score raw applications without history, however few of their fields are filled in.

        Absent fields are missing values, and the ratios are derived from what is there, as in training.
        """
        aligned = align_to_features(applications, self.features)
        derived = {c: e for c, e in derived_columns().items() if c in aligned.columns}
        return self.score(aligned.withColumns(derived))

    def save(self, folder: str) -> None:
        """Everything a new session needs: trees, inputs, feature columns, test scores (bands come from them) and the summary."""
        spark = self.features.sparkSession
        known = json.dumps({"base": self.booster.base, "inputs": asdict(self.inputs)})
        spark.createDataFrame([(known,)], "known string").coalesce(1).write.mode("overwrite").text(f"{folder}/inputs")
        trees = [(i, *map(bytearray, tree_columns(t).values())) for i, t in enumerate(self.booster.trees)]
        named = ", ".join(f"{c} binary" for c in tree_columns())
        spark.createDataFrame(trees, f"number int, {named}").write.mode("overwrite").parquet(f"{folder}/booster")
        self.calibrator.write().overwrite().save(f"{folder}/calibrator")
        for name in ("features", "test_scores", "summary"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_model(spark: SparkSession, folder: str) -> TrainedModel:
    """A model that ``save`` has written; FileNotFoundError where there is none."""
    try:
        tables = [spark.read.parquet(f"{folder}/{name}") for name in ("features", "test_scores", "summary")]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no trained model in {folder}") from error
        raise
    known = json.loads(spark.read.text(f"{folder}/inputs").first()[0])
    inputs = Inputs(**known["inputs"])
    rows = spark.read.parquet(f"{folder}/booster").orderBy("number").collect()  # the size of the model
    booster = BoostedTrees(inputs, known["base"], [tree_of(r, inputs.width) for r in rows])
    return TrainedModel(booster, IsotonicRegressionModel.load(f"{folder}/calibrator"), *tables)


def train(
    matrix: DataFrame, settings: BoostingSettings, strategy: str = "none", baseline_iterations: int = 0
) -> TrainedModel:
    """Fit, stop early, calibrate and judge on four disjoint groups of applicants.

    ``matrix`` should be a stored table: it is read once per stage.
    """
    split = materialise(sampling.assign_split(matrix), "split")
    part = {
        name: split.filter(F.col("split") == name).drop("split")
        for name in ("fit", "early_stop", "calibrate", "test")
    }
    inputs, fit, early_stop = _training_rows(
        part["fit"], part["early_stop"], fit_tree_inputs(part["fit"], settings.max_bins), strategy == "smote"
    )
    rows = {"fit": materialise(fit, "prepared-fit"), "early_stop": materialise(early_stop, "prepared-early-stop")}
    for name in ("calibrate", "test"):
        rows[name] = materialise(prepared_rows(part[name], inputs), f"prepared-{name}")
    weight = sampling.positive_weight(rows["fit"], "y") if strategy == "scale_pos_weight" else None
    booster, course = fit_boosted_trees(resampled(rows["fit"], strategy), rows["early_stop"], inputs, settings, weight)
    calibrator = fit_isotonic(probabilities(booster, rows["calibrate"]))
    test = materialise(calibrate(probabilities(booster, rows["test"]), calibrator), "test-scores")

    numeric, categorical = model_inputs(matrix)
    counts = matrix.agg(F.count(F.lit(1)).alias("rows_trained"), F.avg(LABEL).alias("base_rate"))
    ranking = ranking_metrics(test).drop("ks_statistic")
    raw_gap, gap = F.col("p_raw") - F.col("y"), F.col("p") - F.col("y")
    brier = test.agg(
        exact_mean(raw_gap * raw_gap, FINE_PLACES).alias("test_brier_raw"),
        exact_mean(gap * gap, FINE_PLACES).alias("test_brier_calibrated"),
    )
    operating = cost_threshold(test).select(F.col("threshold").alias("operating_threshold"))
    extras = {
        "n_features": float(len(numeric) + len(categorical)),
        "boosting_rounds": float(len(booster.trees)),
        "early_stop_average_precision": max(course, default=0.0),
        "chosen_strategy": float(STRATEGIES.index(strategy)),
    }
    if baseline_iterations:
        scores = materialise(baseline_scores(matrix, baseline_iterations), "baseline-scores")
        by_fold = ranking_metrics(scores, by=["fold"])
        extras["baseline_pr_auc"] = by_fold.agg(F.avg("average_precision")).first()[0]
    known = [_as_rows(df) for df in (counts, ranking, brier, operating)]
    given = matrix.sparkSession.createDataFrame(list(extras.items()), "metric string, value double")
    summary = reduce(DataFrame.unionByName, [*known, given])
    return TrainedModel(booster, calibrator, matrix.limit(0), test, summary)


def _as_rows(df: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]
    return df.select(F.inline(F.array(*cells)))
