"""Default rates by segment, and the sentence each of them comes down to."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import FINE_PLACES, exact_mean, fixed, is_not_employed, percent, ratio, years
from creditloom.operators.application import ID, LABEL
from creditloom.operators.ordering import global_ntile

Tables = Mapping[str, DataFrame]


def rate_by_segment(
    df: DataFrame, segment: Column, name: str, count_name: str = "applicants", label: str = LABEL
) -> DataFrame:
    """``name, applicants, default_rate`` per value of ``segment``."""
    return df.groupBy(segment.alias(name)).agg(
        F.count(F.lit(1)).alias(count_name), F.avg(label).alias("default_rate")
    )


def age_band() -> Column:
    """Start of the ten-year age band."""
    return (F.floor(years("DAYS_BIRTH") / 10) * 10).cast("long")


def tenure_band() -> Column:
    """Employment length; a missing tenure falls through to the last band."""
    tenure = years("DAYS_EMPLOYED")
    return F.when(tenure < 2, "under 2 years").when(tenure < 5, "2-5 years").otherwise("over 5 years")


def risk_by_score_decile(applications: DataFrame) -> DataFrame:
    """Decile 1 holds the lowest external scores, which are the riskiest."""
    scored = applications.filter(F.col("EXT_SOURCE_2").isNotNull()).select(ID, LABEL, "EXT_SOURCE_2")
    tiled = global_ntile(scored, 10, [F.col("EXT_SOURCE_2").asc(), F.col(ID).asc()], "decile")
    return rate_by_segment(tiled, F.col("decile"), "decile").orderBy("decile")


def risk_by_age_band(applications: DataFrame) -> DataFrame:
    known = applications.filter(F.col("DAYS_BIRTH").isNotNull())
    return rate_by_segment(known, age_band(), "age_band").orderBy("age_band")


def risk_by_employment_band(applications: DataFrame) -> DataFrame:
    band = F.when(is_not_employed(), "not employed").otherwise(tenure_band())
    return rate_by_segment(applications, band, "employment_band").orderBy(
        F.desc("default_rate"), "employment_band"
    )


def risk_by_loan_burden(applications: DataFrame) -> DataFrame:
    burden = ratio("AMT_CREDIT", "AMT_INCOME_TOTAL").alias("burden")
    scored = applications.filter(F.col("AMT_INCOME_TOTAL") > 0).select(ID, LABEL, burden)
    tiled = global_ntile(scored, 5, [F.col("burden").asc_nulls_last(), F.col(ID).asc()], "quintile")
    return (
        tiled.groupBy("quintile")
        .agg(
            F.count(F.lit(1)).alias("applicants"),
            exact_mean("burden", FINE_PLACES).alias("avg_credit_income_ratio"),
            F.avg(LABEL).alias("default_rate"),
        )
        .orderBy("quintile")
    )


def risk_by_contract_type(applications: DataFrame) -> DataFrame:
    return rate_by_segment(applications, F.col("NAME_CONTRACT_TYPE"), "NAME_CONTRACT_TYPE").orderBy(
        F.desc("default_rate"), "NAME_CONTRACT_TYPE"
    )


def _risk_by_client_flag(
    applications: DataFrame, per_client: DataFrame, condition: Column, name: str, yes: str, no: str
) -> DataFrame:
    """Rate by a fact about each client's history; clients without that history are left out.

    The history is reduced to one row per client before the join, so no applicant is counted twice. An unknown
    fact counts as ``no``.
    """
    joined = applications.select(ID, LABEL).join(per_client, ID)
    segment = F.when(condition, yes).otherwise(no)
    return rate_by_segment(joined, segment, name).orderBy(F.desc("default_rate"), name)


def risk_by_bureau_overdue(applications: DataFrame, bureau: DataFrame) -> DataFrame:
    per_client = bureau.groupBy(ID).agg(F.sum("AMT_CREDIT_SUM_OVERDUE").alias("overdue"))
    return _risk_by_client_flag(
        applications,
        per_client,
        F.col("overdue") > 0,
        "overdue_status",
        "has overdue bureau credit",
        "no overdue bureau credit",
    )


def risk_by_previous_refusal(applications: DataFrame, previous: DataFrame) -> DataFrame:
    refused = F.col("NAME_CONTRACT_STATUS") == "Refused"
    per_client = previous.groupBy(ID).agg(F.count_if(refused).alias("refusals"))
    return _risk_by_client_flag(
        applications, per_client, F.col("refusals") > 0, "history", "previously refused", "never refused"
    )


def mean_days_late(installments: DataFrame) -> DataFrame:
    """Average lateness per client over the instalments that were paid."""
    paid = installments.filter(F.col("DAYS_ENTRY_PAYMENT").isNotNull())
    late = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return paid.groupBy(ID).agg(F.avg(late).alias("avg_days_late"))


def risk_by_installment_lateness(applications: DataFrame, installments: DataFrame) -> DataFrame:
    return _risk_by_client_flag(
        applications,
        mean_days_late(installments),
        F.col("avg_days_late") > 5,
        "payment_behaviour",
        "often pay late",
        "pay on time or early",
    )


# --- headlines ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Insight:
    """A segment table and the sentence it supports, with the columns it cannot do without."""

    id: str
    needs: dict[str, tuple[str, ...]]
    rows: Callable[[Tables], DataFrame]
    #: Aggregates over ``rows``; the first one is NULL when there were no rows.
    facts: dict[str, Column]
    sentence: Column

    def available(self, tables: Tables) -> bool:
        return all(t in tables and set(columns) <= set(tables[t].columns) for t, columns in self.needs.items())

    def headline(self, tables: Tables) -> DataFrame:
        facts = self.rows(tables).agg(*[c.alias(name) for name, c in self.facts.items()])
        told = facts.filter(F.col(next(iter(self.facts))).isNotNull())
        return told.select(F.lit(self.id).alias("insight_id"), self.sentence.alias("headline"))


def _rate_at(end: str, key: str) -> Column:
    pick = F.min_by if end == "first" else F.max_by
    return pick("default_rate", key)


def _worst_of(segment: str) -> dict[str, Column]:
    """Highest and lowest rate; equal rates are decided by the segment name."""
    highest = F.min_by(F.struct(segment, "default_rate"), F.struct(-F.col("default_rate"), F.col(segment)))
    lowest = F.max_by(F.struct(segment, "default_rate"), F.struct(-F.col("default_rate"), F.col(segment)))
    return {"worst": highest, "best": lowest}


def _sentence(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def loan_burden_shape(by_quintile: DataFrame) -> DataFrame:
    """Riskiest and safest quintile by observed rate, and whether risk simply rises with the burden."""
    rate, quintile = F.col("default_rate"), F.col("quintile")
    shape = by_quintile.agg(
        F.min_by("quintile", F.struct(-rate, quintile)).alias("riskiest_quintile"),
        F.min_by("quintile", F.struct(rate, quintile)).alias("safest_quintile"),
        F.min("quintile").alias("lightest"),
        F.max("quintile").alias("heaviest"),
    )
    monotonic = (F.col("riskiest_quintile") == F.col("heaviest")) & (
        F.col("safest_quintile") == F.col("lightest")
    )
    return shape.select("riskiest_quintile", "safest_quintile", monotonic.alias("is_monotonic"))


def insights() -> list[Insight]:
    """Every insight with its sentence (fixed wording)."""
    worst_rate, best_rate = percent("worst.default_rate"), percent("best.default_rate")
    quintile = F.struct("quintile", "avg_credit_income_ratio", "default_rate")
    return [
        Insight(
            "ext_source_decile",
            {"application_train": (ID, LABEL, "EXT_SOURCE_2")},
            lambda t: risk_by_score_decile(t["application_train"]),
            {"bottom": _rate_at("first", "decile"), "top": _rate_at("last", "decile")},
            F.concat(
                _sentence(
                    "The bottom EXT_SOURCE_2 decile defaults at %s, versus %s in the top decile",
                    percent("bottom"),
                    percent("top"),
                ),
                F.when(F.col("top") > 0, _sentence(" - %sx the risk.", fixed(ratio("bottom", "top"), 1))).otherwise("."),
            ),
        ),
        Insight(
            "age_vs_default",
            {"application_train": (LABEL, "DAYS_BIRTH")},
            lambda t: risk_by_age_band(t["application_train"]),
            {
                "youngest": F.min("age_band"),
                "oldest": F.max("age_band"),
                "young_rate": _rate_at("first", "age_band"),
                "old_rate": _rate_at("last", "age_band"),
            },
            _sentence(
                "Applicants in their %ds default at %s, versus %s for those in their %ds.",
                F.col("youngest"),
                percent("young_rate"),
                percent("old_rate"),
                F.col("oldest"),
            ),
        ),
        Insight(
            "employment_vs_default",
            {"application_train": (LABEL, "DAYS_EMPLOYED")},
            lambda t: risk_by_employment_band(t["application_train"]),
            _worst_of("employment_band"),
            _sentence(
                "'%s' applicants default most often, at %s.", F.col("worst.employment_band"), worst_rate
            ),
        ),
        Insight(
            "loan_burden_vs_default",
            {"application_train": (ID, LABEL, "AMT_CREDIT", "AMT_INCOME_TOTAL")},
            lambda t: risk_by_loan_burden(t["application_train"]),
            {
                "worst": F.min_by(quintile, F.struct(-F.col("default_rate"), F.col("quintile"))),
                "best": F.min_by(quintile, F.struct(F.col("default_rate"), F.col("quintile"))),
            },
            _sentence(
                "Quintile %d (avg ratio %sx income) defaults most often, at %s, versus %s in quintile %d "
                "(avg ratio %sx).",
                F.col("worst.quintile"),
                fixed(F.col("worst.avg_credit_income_ratio"), 1),
                worst_rate,
                best_rate,
                F.col("best.quintile"),
                fixed(F.col("best.avg_credit_income_ratio"), 1),
            ),
        ),
        Insight(
            "contract_type_vs_default",
            {"application_train": (LABEL, "NAME_CONTRACT_TYPE")},
            lambda t: risk_by_contract_type(t["application_train"]),
            _worst_of("NAME_CONTRACT_TYPE"),
            _sentence(
                "%s applicants default at %s, the highest of the contract types.",
                F.col("worst.NAME_CONTRACT_TYPE"),
                worst_rate,
            ),
        ),
        Insight(
            "bureau_overdue_vs_default",
            {"application_train": (ID, LABEL), "bureau": (ID, "AMT_CREDIT_SUM_OVERDUE")},
            lambda t: risk_by_bureau_overdue(t["application_train"], t["bureau"]),
            _worst_of("overdue_status"),
            _sentence(
                "Clients with overdue bureau credit default at %s, versus %s for those with none.",
                worst_rate,
                best_rate,
            ),
        ),
        Insight(
            "previous_refusal_vs_default",
            {"application_train": (ID, LABEL), "previous_application": (ID, "NAME_CONTRACT_STATUS")},
            lambda t: risk_by_previous_refusal(t["application_train"], t["previous_application"]),
            _worst_of("history"),
            _sentence("Clients %s default at %s.", F.col("worst.history"), worst_rate),
        ),
        Insight(
            "installment_lateness_vs_default",
            {
                "application_train": (ID, LABEL),
                "installments_payments": (ID, "DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT"),
            },
            lambda t: risk_by_installment_lateness(t["application_train"], t["installments_payments"]),
            _worst_of("payment_behaviour"),
            _sentence("Clients who %s default at %s.", F.col("worst.payment_behaviour"), worst_rate),
        ),
    ]


def insight_headlines(tables: Tables) -> DataFrame:
    """One sentence per insight; insights with missing tables, missing columns or no rows are skipped."""
    parts = [i.headline(tables) for i in insights() if i.available(tables)]
    return reduce(DataFrame.unionByName, parts)
