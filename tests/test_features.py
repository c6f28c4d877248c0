from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from creditloom.functions import exact_mean, exact_sum
from creditloom.functions.exact import unrounded_sum
from creditloom.operators import history
from creditloom.operators.application import derived_features
from creditloom.operators.feature_matrix import applicant_lookup, feature_matrix, model_inputs
from creditloom.sources.testbed import Testbed
from tests.conftest import SF, plan_of, rows

EMPTY_CHILDREN = {
    "bureau": "SK_ID_CURR long, SK_ID_BUREAU long, CREDIT_ACTIVE string, CREDIT_TYPE string, DAYS_CREDIT long, "
    "CREDIT_DAY_OVERDUE long, AMT_CREDIT_MAX_OVERDUE double, CNT_CREDIT_PROLONG long, AMT_CREDIT_SUM double, "
    "AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_SUM_OVERDUE double, DAYS_CREDIT_UPDATE long, AMT_ANNUITY double",
    "bureau_balance": "SK_ID_BUREAU long, MONTHS_BALANCE long, STATUS string",
    "previous_application": "SK_ID_CURR long, SK_ID_PREV long, NAME_CONTRACT_STATUS string, AMT_APPLICATION double, "
    "AMT_CREDIT double, AMT_DOWN_PAYMENT double, CNT_PAYMENT double, DAYS_DECISION long, CODE_REJECT_REASON string",
    "installments_payments": "SK_ID_CURR long, SK_ID_PREV long, DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, "
    "AMT_INSTALMENT double, AMT_PAYMENT double",
    "credit_card_balance": "SK_ID_CURR long, SK_ID_PREV long, AMT_BALANCE double, AMT_CREDIT_LIMIT_ACTUAL long, "
    "AMT_DRAWINGS_CURRENT double, CNT_DRAWINGS_CURRENT long, SK_DPD long",
    "pos_cash_balance": "SK_ID_CURR long, SK_ID_PREV long, MONTHS_BALANCE long, CNT_INSTALMENT_FUTURE double, "
    "SK_DPD long, SK_DPD_DEF long",
}


def newcomers(spark, n):
    i = F.col("id")
    nothing = [F.lit(None).cast("double").alias(c) for c in ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "AMT_ANNUITY", "AMT_GOODS_PRICE")]
    application = spark.range(n).select(
        i.alias("SK_ID_CURR"),
        (i % 10 == 0).cast("long").alias("TARGET"),
        (50000.0 + i).alias("AMT_INCOME_TOTAL"),
        (100000.0 + i).alias("AMT_CREDIT"),
        (-10000 - i).alias("DAYS_BIRTH"),
        (-1000 - i).alias("DAYS_EMPLOYED"),
        *nothing,
        F.lit(1.0).alias("CNT_FAM_MEMBERS"),
        F.lit(0).cast("long").alias("CNT_CHILDREN"),
        F.lit(-100.0).alias("DAYS_REGISTRATION"),
        F.lit(-100).cast("long").alias("DAYS_ID_PUBLISH"),
        F.when(i % 3 == 0, "A").otherwise("B").alias("NAME_EDUCATION_TYPE"),
    )
    empty = {name: spark.createDataFrame([], schema) for name, schema in EMPTY_CHILDREN.items()}
    return empty | {"application_train": application}


def test_clients_without_history_keep_their_row(spark):
    matrix = feature_matrix(newcomers(spark, 500))
    numeric, categorical = model_inputs(matrix)
    assert categorical == ["NAME_EDUCATION_TYPE"]
    assert not {"SK_ID_CURR", "TARGET"} & set(numeric)
    facts = matrix.agg(
        F.count(F.lit(1)), F.countDistinct("SK_ID_CURR"), F.count("BUR_COUNT"), F.count("POS_MONTHS"), F.count("CC_CARDS")
    ).first()
    assert tuple(facts) == (500, 500, 0, 0, 0)


def test_eighty_five_engineered_features(spark):
    tables = newcomers(spark, 5)
    assert len(feature_matrix(tables).columns) - len(tables["application_train"].columns) == 85


def test_missing_scores_and_sentinel(spark):
    tables = newcomers(spark, 1)
    app = tables["application_train"].withColumn("DAYS_EMPLOYED", F.lit(365243).cast("long"))
    r = derived_features(app).first()
    assert (r["EXT_SOURCE_MEAN"], r["EXT_SOURCE_MIN"], r["EXT_SOURCE_MAX"]) == (None, 1.0, 0.0)
    assert (r["EXT_SOURCE_PRODUCT"], r["EXT_SOURCE_MISSING_COUNT"]) == (0.0, 3)
    assert (r["YEARS_EMPLOYED"], r["FLAG_NOT_EMPLOYED"]) == (None, 1)
    zero = derived_features(app.withColumn("AMT_INCOME_TOTAL", F.lit(0.0))).first()
    assert zero["CREDIT_INCOME_RATIO"] is None


def test_worst_status_ignores_letters(spark):
    bureau = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "SK_ID_CURR long, SK_ID_BUREAU long")
    months = [(10, -1, "C"), (10, -2, "3"), (11, -7, "0"), (12, -1, "X"), (99, -1, "5")]
    balance = spark.createDataFrame(months, "SK_ID_BUREAU long, MONTHS_BALANCE long, STATUS string")
    got = {r["SK_ID_CURR"]: r for r in history.summarise_bureau_balance(balance, bureau).collect()}
    assert got[1]["BURBAL_MONTHS"] == 3 and got[1]["BURBAL_WORST_STATUS"] == 3
    assert got[1]["BURBAL_DPD_RATIO"] == pytest.approx(1 / 3) and got[1]["BURBAL_OLDEST_MONTH"] == -7
    assert got[2]["BURBAL_WORST_STATUS"] is None and got[2]["BURBAL_DPD_MONTHS"] == 0


def test_sums_do_not_depend_on_partitioning(spark):
    tables = Testbed(spark, SF)
    one = history.summarise_installments(tables["installments_payments"].coalesce(1))
    many = history.summarise_installments(tables["installments_payments"].repartition(7, "AMT_PAYMENT"))
    assert sorted(rows(one)) == sorted(rows(many))


def test_lookup_prefers_the_labelled_table_and_falls_back(spark):
    tables = Testbed(spark, SF)
    found = {r["SK_ID_CURR"]: r for r in applicant_lookup(tables, [7, 1_000_007, -5]).collect()}
    assert set(found) == {7, 1_000_007}
    assert found[7]["SOURCE_TABLE"] == "application_train" and found[7]["TARGET"] is not None
    assert found[1_000_007]["SOURCE_TABLE"] == "application_test" and found[1_000_007]["TARGET"] is None
    whole = {r["SK_ID_CURR"]: r for r in feature_matrix(tables).filter("SK_ID_CURR = 7").collect()}
    shared = set(whole[7].asDict()) & set(found[7].asDict())
    assert {k: found[7][k] for k in shared} == {k: whole[7][k] for k in shared}


def test_an_id_filter_reaches_every_scan_with_that_id(spark):
    plan = plan_of(feature_matrix(Testbed(spark, SF)).filter("SK_ID_CURR = 7"))
    assert plan.count("EqualTo(o_custkey,7)") >= 4 and "EqualTo(c_custkey,7)" in plan and "EqualTo(user_id,7)" in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(history.summarise_bureau_balance(Testbed(spark, SF)["bureau_balance"], Testbed(spark, SF)["bureau"]))
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


@pytest.mark.parametrize(
    ("values", "total"),
    [
        ([1e15, 1e15], 2e15),
        ([2e-5] * 10, 2e-4),
        ([3e10, 1.0, -3e10], 1.0),
        ([1e300, 1e300], 2e300),
        ([1e16, 1.0, -1e16] * 50, 50.0),
        ([None, None], None),
        ([None, 0.25], 0.25),
    ],
)
def test_sums_keep_their_range(spark, values, total):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    row = df.agg(exact_sum("v").alias("s"), exact_mean("v").alias("m")).first()
    assert row["s"] == total
    if total is not None and abs(total) < 1e15:
        assert row["m"] == pytest.approx(total / sum(v is not None for v in values), abs=1e-6)


def test_sums_of_special_values_follow_ieee(spark):
    def total(*values):
        return spark.createDataFrame([(float(v),) for v in values], "v double").agg(exact_sum("v")).first()[0]

    assert total("inf", 1) == math.inf and total("-inf", 1) == -math.inf
    assert math.isnan(total("nan", 1)) and math.isnan(total("inf", "-inf"))


def test_sums_do_not_depend_on_the_order(spark):
    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-6, 12) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = {df.repartition(n).agg(unrounded_sum("v")).first()[0] for n in (1, 3, 7)}
    assert found == {math.fsum(values)} or len(found) == 1 and found.pop() == pytest.approx(math.fsum(values), rel=1e-15)
