"""Registered queries: samples, splits and class balance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import sampling
from creditloom.operators.application import ID, LABEL
from creditloom.operators.restriction import restrict_to_clients
from creditloom.plans.registry import query

APP = "application_train"
SAMPLE_SIZE = 400


@query("stratified_rank")
def _stratified_rank(t) -> DataFrame:
    return sampling.stratified_rank(t[APP])


@query("stratified_sample")
def _stratified_sample(t) -> DataFrame:
    return sampling.stratified_sample(t[APP], SAMPLE_SIZE).select(ID, LABEL)


@query("hash_percent_sample")
def _hash_percent_sample(t) -> DataFrame:
    return sampling.hash_percent_sample(t["application_test"]).select(ID, "AMT_CREDIT")


@query("hash_order_sample")
def _hash_order_sample(t) -> DataFrame:
    shown = (ID, "AMT_INCOME_TOTAL", "AMT_CREDIT", "CODE_GENDER", "NAME_EDUCATION_TYPE", LABEL)
    return sampling.hash_order_sample(t[APP].select(*shown), 20)


@query("train_holdout_split")
def _train_holdout_split(t) -> DataFrame:
    return sampling.assign_split(t[APP].select(ID, LABEL))


@query("kfold_assign")
def _kfold_assign(t) -> DataFrame:
    return sampling.assign_fold(t[APP].select(ID, LABEL))


@query("undersample_majority")
def _undersample_majority(t) -> DataFrame:
    """Within the training fold only."""
    folded = sampling.assign_fold(t[APP].select(ID, LABEL))
    return sampling.undersample_majority(folded.filter(F.col("fold") != 1)).select(ID, LABEL)


@query("class_weights")
def _class_weights(t) -> DataFrame:
    return sampling.class_weights(t[APP].select(ID, LABEL))


@query("lite_cascade")
def _lite_cascade(t) -> DataFrame:
    """Rows kept per table when the portfolio is reduced to a stratified sample of clients."""
    sample = sampling.stratified_sample(t[APP], SAMPLE_SIZE)
    kept = {APP: sample, "application_test": sampling.hash_percent_sample(t["application_test"])}
    kept |= restrict_to_clients(t, sample)
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in kept.items()
    ]
    return reduce(DataFrame.unionByName, counts)
