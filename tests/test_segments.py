from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from creditloom.operators import adhoc, quality, segments
from tests.conftest import rows


def counts(df):
    return {r[0]: r[1] for r in df.collect()}


def test_client_flags_split_clients_with_history_only(portfolio):
    app = portfolio["application_train"]
    overdue = counts(segments.risk_by_bureau_overdue(app, portfolio["bureau"]))
    assert overdue == {"has overdue bureau credit": 5, "no overdue bureau credit": 10}
    refused = counts(segments.risk_by_previous_refusal(app, portfolio["previous_application"]))
    assert refused == {"previously refused": 5, "never refused": 10}
    late = counts(segments.risk_by_installment_lateness(app, portfolio["installments_payments"]))
    assert late == {"often pay late": 5, "pay on time or early": 10}


def test_lift_is_bottom_decile_over_top_decile(spark):
    i = F.col("id")
    target = F.when(i < 10, i % 5 < 2).when(i >= 90, i % 10 == 0).otherwise(i % 4 == 0)
    app = spark.range(100).select(
        i.alias("SK_ID_CURR"), target.cast("long").alias("TARGET"), (i / 100).alias("EXT_SOURCE_2")
    )
    deciles = rows(segments.risk_by_score_decile(app))
    assert [d[0] for d in deciles] == list(range(1, 11))
    assert all(d[1] == 10 for d in deciles)
    assert deciles[0][2] == pytest.approx(0.4) and deciles[-1][2] == pytest.approx(0.1)
    headline = segments.insight_headlines({"application_train": app}).first()
    assert headline["insight_id"] == "ext_source_decile"
    assert "40.0%, versus 10.0%" in headline["headline"] and "4.0x" in headline["headline"]


def test_peak_inside_the_range_is_not_monotonic(spark):
    i = F.col("id")
    app = spark.range(100).select(
        i.alias("SK_ID_CURR"),
        i.between(45, 54).cast("long").alias("TARGET"),
        F.lit(100000.0).alias("AMT_INCOME_TOTAL"),
        ((i + 1) * 20000.0).alias("AMT_CREDIT"),
    )
    shape = segments.loan_burden_shape(segments.risk_by_loan_burden(app)).first()
    assert shape["riskiest_quintile"] == 3 and shape["is_monotonic"] is False


def test_missing_tables_and_empty_tables_skip_their_insights(portfolio):
    partial = {"application_train": portfolio["application_train"], "bureau": portfolio["bureau"].limit(0)}
    told = {r["insight_id"] for r in segments.insight_headlines(partial).collect()}
    assert "bureau_overdue_vs_default" not in told and "previous_refusal_vs_default" not in told
    assert {"ext_source_decile", "age_vs_default", "employment_vs_default"} <= told


def test_missing_tenure_falls_into_the_last_band(spark):
    app = spark.createDataFrame(
        [(1, 0, None), (2, 1, -3650), (3, 0, 365243)], "SK_ID_CURR long, TARGET long, DAYS_EMPLOYED long"
    )
    assert counts(segments.risk_by_employment_band(app)) == {"over 5 years": 2, "not employed": 1}
    assert counts(adhoc.rate_by_tenure(app)) == {"over 5 years": 1}


def test_quality_findings(portfolio):
    found = {(r["finding"], r["metric"]): r["value"] for r in quality.quality_report(portfolio["application_train"]).collect()}
    assert found["days_employed_sentinel", "count"] == 10
    assert found["gender_xna", "count"] == 1
    assert found["class_imbalance", "default_rate"] == pytest.approx(0.2)
    assert found["income_outlier", "median"] == pytest.approx(60000.0)
    assert found["building_stats_missing", "max_pct_missing"] == pytest.approx(0.25)
    assert found["days_columns_sign", "columns_checked"] == 1


def test_checks_without_their_columns_are_skipped(portfolio):
    narrow = portfolio["application_train"].select("SK_ID_CURR", "TARGET")
    assert {r["finding"] for r in quality.quality_report(narrow).collect()} == {"class_imbalance"}
    assert quality.quality_report(narrow.limit(0)).count() == 0


def test_missing_values(portfolio):
    report = quality.missing_values(portfolio, ["application_train"])
    found = {r["column_name"]: (r["category"], r["n_missing"]) for r in report.collect()}
    assert found == {"APARTMENTS_AVG": ("housing_detail", 5), "AMT_INCOME_TOTAL": ("financial", 1)}


def test_category_order_decides(spark):
    names = spark.createDataFrame([("AMT_CREDIT_SUM",), ("amt_annuity",), ("SOMETHING",)], "n string")
    assert [r[0] for r in names.select(quality.business_category("n")).collect()] == ["financial", "financial", "other"]


def test_table_summary(portfolio):
    summary = rows(quality.table_summary(portfolio, {"bureau": "credits"}))
    assert summary[0][0] == "application_train" and summary[0][2:4] == (20, 10)


@pytest.mark.parametrize(("size", "bound", "expected", "truncated"), [(1000, 10, 10, True), (10, 10, 10, False), (0, 10, 0, None)])
def test_bounded_result(spark, size, bound, expected, truncated):
    found = adhoc.bounded_result(spark.range(size).orderBy("id"), bound).collect()
    assert len(found) == expected and [r["id"] for r in found] == list(range(expected))
    assert all(r["truncated"] is truncated for r in found)


def test_bound_must_be_sensible(spark):
    with pytest.raises(ValueError):
        adhoc.bounded_result(spark.range(1), 0)


def test_fan_out_counts_rows_not_clients(spark):
    app = spark.createDataFrame([(1, 1), (2, 0)], "SK_ID_CURR long, TARGET long")
    bureau = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 13)], "SK_ID_CURR long, SK_ID_BUREAU long")
    assert rows(adhoc.naive_join_fanout(app, bureau)) == [(4, 2, 0.75, 0.5)]


def test_exploration_is_written_whole(spark, portfolio, tmp_path):
    from creditloom.plans.exploration import write_exploration

    write_exploration(portfolio, str(tmp_path))
    shown = spark.read.json(f"{tmp_path}/insight_segments")
    assert shown.select("insight_id").distinct().count() == 8
    assert spark.read.json(f"{tmp_path}/insight_headlines").count() == 8
    assert spark.read.json(f"{tmp_path}/feature_categories").count() == 10
