"""Registered queries: segments, quality and direct questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import adhoc, quality, segments
from creditloom.operators.application import ID, LABEL
from creditloom.operators.ordering import global_ntile
from creditloom.plans.registry import query
from creditloom.sources.manifest import DESCRIPTIONS

APP = "application_train"

_ON_APPLICATIONS = {
    "risk_by_score_decile": segments.risk_by_score_decile,
    "risk_by_age_band": segments.risk_by_age_band,
    "risk_by_employment_band": segments.risk_by_employment_band,
    "risk_by_loan_burden": segments.risk_by_loan_burden,
    "risk_by_contract_type": segments.risk_by_contract_type,
    "overall_default_rate": adhoc.overall_default_rate,
    "rate_by_education": adhoc.rate_by_education,
    "rate_by_age_band": adhoc.rate_by_age_band,
    "rate_by_tenure": adhoc.rate_by_tenure,
    "rate_by_decile": adhoc.rate_by_decile,
    "rate_by_product": adhoc.rate_by_product,
    "derived_table_sort": adhoc.derived_table_sort,
    "avg_income_defaulted": adhoc.avg_income_defaulted,
    "scalar_pack": adhoc.scalar_pack,
    "quality_report": quality.quality_report,
}

_ON_APPLICATIONS_AND = {
    "risk_by_bureau_overdue": ("bureau", segments.risk_by_bureau_overdue),
    "risk_by_previous_refusal": ("previous_application", segments.risk_by_previous_refusal),
    "risk_by_installment_lateness": ("installments_payments", segments.risk_by_installment_lateness),
    "rate_by_credit_count": ("bureau", adhoc.rate_by_credit_count),
    "lateness_by_outcome": ("installments_payments", adhoc.lateness_by_outcome),
    "exposure_by_outcome": ("bureau", adhoc.exposure_by_outcome),
    "credits_by_gender": ("bureau", adhoc.credits_by_gender),
    "naive_join_fanout": ("bureau", adhoc.naive_join_fanout),
}

_QUALITY = {
    "quality_sentinel": "days_employed_sentinel",
    "quality_unknown_category": "gender_xna",
    "quality_income_outlier": "income_outlier",
    "quality_days_sign": "days_columns_sign",
    "quality_block_missing": "building_stats_missing",
    "quality_class_imbalance": "class_imbalance",
}

for _name, _operator in _ON_APPLICATIONS.items():
    query(_name)(lambda t, operator=_operator: operator(t[APP]))

for _name, (_table, _operator) in _ON_APPLICATIONS_AND.items():
    query(_name)(lambda t, table=_table, operator=_operator: operator(t[APP], t[table]))

for _name, _check in _QUALITY.items():
    query(_name)(lambda t, check=_check: quality.quality_report(t[APP], [check]))


@query("loan_burden_shape")
def _loan_burden_shape(t) -> DataFrame:
    return segments.loan_burden_shape(segments.risk_by_loan_burden(t[APP]))


@query("insight_headlines")
def _insight_headlines(t) -> DataFrame:
    return segments.insight_headlines(t)


@query("missing_values")
def _missing_values(t) -> DataFrame:
    return quality.missing_values(t)


@query("column_categories")
def _column_categories(t) -> DataFrame:
    return quality.column_categories(t[APP], APP)


@query("table_summary")
def _table_summary(t) -> DataFrame:
    return quality.table_summary(t, DESCRIPTIONS)


@query("global_ntile")
def _global_ntile(t) -> DataFrame:
    """Tiles over a nullable ratio: unknown ratios sort last."""
    burden = t[APP].select(ID, (F.col("AMT_CREDIT") / F.nullif("AMT_INCOME_TOTAL", F.lit(0))).alias("burden"))
    return global_ntile(burden, 7, [F.col("burden").asc_nulls_last(), F.col(ID).asc()])


@query("clients_with_refusal")
def _clients_with_refusal(t) -> DataFrame:
    return adhoc.clients_with_refusal(t["previous_application"])


@query("top_occupations")
def _top_occupations(t) -> DataFrame:
    return adhoc.top_by_mean(t[APP], "OCCUPATION_TYPE", "AMT_CREDIT", "avg_loan_amount")


@query("top_k_by_metric")
def _top_k_by_metric(t) -> DataFrame:
    """The ten clients with the highest mean card balance."""
    return adhoc.top_by_mean(t["credit_card_balance"], ID, "AMT_BALANCE", "avg_balance")


@query("bounded_result")
def _bounded_result(t) -> DataFrame:
    listing = t[APP].select(ID, "AMT_CREDIT", LABEL).orderBy(F.desc("AMT_CREDIT"), ID)
    return adhoc.bounded_result(listing)


@query("status_distribution")
def _status_distribution(t) -> DataFrame:
    return adhoc.status_distribution(t["bureau_balance"], t["bureau"])


@query("filtered_count")
def _filtered_count(t) -> DataFrame:
    return adhoc.filtered_count(t[APP], F.col("AMT_INCOME_TOTAL") > 200000)
