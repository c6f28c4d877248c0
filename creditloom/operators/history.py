"""Per-client summaries of the one-to-many history tables.

Each summary is one partial/final hash aggregate on the client id, so a client holding a large share of a
table is reduced on the map side before anything is shuffled. Distinct counts use Spark's two-phase plan,
which spreads a hot client over its distinct values. Amounts are added exactly (see ``functions.exact``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import FINE_PLACES, exact_mean, exact_sum, ratio
from creditloom.operators.application import ID


def _rows() -> Column:
    return F.count(F.lit(1))


def _share(condition: Column) -> Column:
    """Rows where the condition holds over all rows; an unknown condition does not count."""
    return ratio(F.count_if(condition), _rows())


def summarise_bureau(bureau: DataFrame, key: str = ID) -> DataFrame:
    active = F.col("CREDIT_ACTIVE") == "Active"
    closed = F.col("CREDIT_ACTIVE") == "Closed"
    return bureau.groupBy(key).agg(
        _rows().alias("BUR_COUNT"),
        F.count_if(active).alias("BUR_ACTIVE_COUNT"),
        F.count_if(closed).alias("BUR_CLOSED_COUNT"),
        _share(active).alias("BUR_ACTIVE_RATIO"),
        F.countDistinct("CREDIT_TYPE").alias("BUR_CREDIT_TYPES"),
        exact_sum("AMT_CREDIT_SUM").alias("BUR_CREDIT_SUM_TOTAL"),
        exact_mean("AMT_CREDIT_SUM").alias("BUR_CREDIT_SUM_MEAN"),
        F.max("AMT_CREDIT_SUM").alias("BUR_CREDIT_SUM_MAX"),
        exact_sum("AMT_CREDIT_SUM_DEBT").alias("BUR_DEBT_TOTAL"),
        ratio(exact_sum("AMT_CREDIT_SUM_DEBT"), exact_sum("AMT_CREDIT_SUM")).alias(
            "BUR_DEBT_CREDIT_RATIO"
        ),
        exact_sum("AMT_CREDIT_SUM_OVERDUE").alias("BUR_OVERDUE_TOTAL"),
        F.max("AMT_CREDIT_MAX_OVERDUE").alias("BUR_MAX_OVERDUE_EVER"),
        F.max("CREDIT_DAY_OVERDUE").alias("BUR_DAYS_OVERDUE_MAX"),
        F.count_if(F.col("CREDIT_DAY_OVERDUE") > 0).alias("BUR_OVERDUE_COUNT"),
        F.sum("CNT_CREDIT_PROLONG").alias("BUR_PROLONG_TOTAL"),
        F.min("DAYS_CREDIT").alias("BUR_DAYS_CREDIT_MIN"),
        F.max("DAYS_CREDIT").alias("BUR_DAYS_CREDIT_MAX"),
        F.avg("DAYS_CREDIT").alias("BUR_DAYS_CREDIT_MEAN"),
        F.max("DAYS_CREDIT_UPDATE").alias("BUR_LAST_UPDATE"),
        exact_mean("AMT_ANNUITY").alias("BUR_ANNUITY_MEAN"),
    )


def summarise_bureau_balance(balance: DataFrame, bureau: DataFrame, key: str = ID) -> DataFrame:
    """Monthly statuses reach a client only through the credit they belong to.

    The months of one credit are reduced to a single row before the join: the join then moves one row per
    credit instead of one per month, and a credit with very many months cannot skew it.
    """
    status = F.col("STATUS")
    per_credit = balance.groupBy("SK_ID_BUREAU").agg(
        _rows().alias("months"),
        # A text range on purpose: 'C' and 'X' sort outside it.
        F.count_if(status.between("1", "5")).alias("late_months"),
        # The known letters are skipped first: a failing cast costs far more than a comparison.
        F.max(F.when(~status.isin("C", "X"), status.try_cast("int"))).alias("worst_status"),
        F.count_if(status == "C").alias("closed_months"),
        F.min("MONTHS_BALANCE").alias("oldest_month"),
    )
    months = F.sum("months")
    return (
        bureau.select(key, "SK_ID_BUREAU")
        .join(per_credit, "SK_ID_BUREAU")
        .groupBy(key)
        .agg(
            months.alias("BURBAL_MONTHS"),
            F.sum("late_months").alias("BURBAL_DPD_MONTHS"),
            ratio(F.sum("late_months"), months).alias("BURBAL_DPD_RATIO"),
            F.max("worst_status").alias("BURBAL_WORST_STATUS"),
            ratio(F.sum("closed_months"), months).alias("BURBAL_CLOSED_RATIO"),
            F.min("oldest_month").alias("BURBAL_OLDEST_MONTH"),
        )
    )


def summarise_previous_applications(previous: DataFrame, key: str = ID) -> DataFrame:
    outcome, reason = F.col("NAME_CONTRACT_STATUS"), F.col("CODE_REJECT_REASON")
    real_reason = F.when(~reason.isin("XAP", "XNA"), reason)
    return previous.groupBy(key).agg(
        _rows().alias("PREV_COUNT"),
        F.count_if(outcome == "Approved").alias("PREV_APPROVED"),
        F.count_if(outcome == "Refused").alias("PREV_REFUSED"),
        _share(outcome == "Refused").alias("PREV_REFUSAL_RATE"),
        _share(outcome == "Canceled").alias("PREV_CANCEL_RATE"),
        exact_mean("AMT_APPLICATION").alias("PREV_APPLICATION_MEAN"),
        exact_mean("AMT_CREDIT").alias("PREV_CREDIT_MEAN"),
        exact_mean(ratio("AMT_CREDIT", "AMT_APPLICATION"), FINE_PLACES).alias("PREV_GRANTED_RATIO"),
        exact_mean("AMT_DOWN_PAYMENT").alias("PREV_DOWNPAYMENT_MEAN"),
        F.avg("CNT_PAYMENT").alias("PREV_TERM_MEAN"),
        F.max("DAYS_DECISION").alias("PREV_LAST_DECISION"),
        F.min("DAYS_DECISION").alias("PREV_FIRST_DECISION"),
        F.countDistinct(real_reason).alias("PREV_REJECT_REASONS"),
    )


def summarise_installments(installments: DataFrame, key: str = ID) -> DataFrame:
    """Positive lateness means paid after the due date, positive shortfall means paid less than due."""
    late = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    short = F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT")
    return installments.groupBy(key).agg(
        _rows().alias("INST_COUNT"),
        F.avg(late).alias("INST_DAYS_LATE_MEAN"),
        F.max(late).alias("INST_DAYS_LATE_MAX"),
        _share(late > 0).alias("INST_LATE_RATIO"),
        _share(late > 30).alias("INST_LATE_30D_RATIO"),
        exact_mean(short).alias("INST_SHORTFALL_MEAN"),
        exact_sum(short).alias("INST_SHORTFALL_TOTAL"),
        F.max(short).alias("INST_SHORTFALL_MAX"),
        _share(F.col("AMT_PAYMENT") < F.col("AMT_INSTALMENT")).alias("INST_UNDERPAID_RATIO"),
        ratio(exact_sum("AMT_PAYMENT"), exact_sum("AMT_INSTALMENT")).alias(
            "INST_PAYMENT_RATIO"
        ),
        F.max("DAYS_INSTALMENT").alias("INST_LAST_DUE"),
    )


def summarise_credit_card(statements: DataFrame, key: str = ID) -> DataFrame:
    utilisation = ratio("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL")
    return statements.groupBy(key).agg(
        _rows().alias("CC_MONTHS"),
        F.countDistinct("SK_ID_PREV").alias("CC_CARDS"),
        exact_mean("AMT_BALANCE").alias("CC_BALANCE_MEAN"),
        F.max("AMT_BALANCE").alias("CC_BALANCE_MAX"),
        exact_mean(utilisation, FINE_PLACES).alias("CC_UTILISATION_MEAN"),
        F.max(utilisation).alias("CC_UTILISATION_MAX"),
        exact_mean("AMT_DRAWINGS_CURRENT").alias("CC_DRAWINGS_MEAN"),
        F.avg("CNT_DRAWINGS_CURRENT").alias("CC_DRAWINGS_COUNT_MEAN"),
        F.max("SK_DPD").alias("CC_DPD_MAX"),
        _share(F.col("SK_DPD") > 0).alias("CC_DPD_RATIO"),
    )


def summarise_pos_cash(balances: DataFrame, key: str = ID) -> DataFrame:
    return balances.groupBy(key).agg(
        _rows().alias("POS_MONTHS"),
        F.countDistinct("SK_ID_PREV").alias("POS_CONTRACTS"),
        F.max("SK_DPD").alias("POS_DPD_MAX"),
        F.avg("SK_DPD").alias("POS_DPD_MEAN"),
        _share(F.col("SK_DPD") > 0).alias("POS_DPD_RATIO"),
        F.max("SK_DPD_DEF").alias("POS_DPD_DEF_MAX"),
        F.avg("CNT_INSTALMENT_FUTURE").alias("POS_REMAINING_MEAN"),
        F.min("MONTHS_BALANCE").alias("POS_OLDEST_MONTH"),
    )


SUMMARIES: dict[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = {
    "bureau": lambda t: summarise_bureau(t["bureau"]),
    "bureau_balance": lambda t: summarise_bureau_balance(t["bureau_balance"], t["bureau"]),
    "previous_application": lambda t: summarise_previous_applications(t["previous_application"]),
    "installments_payments": lambda t: summarise_installments(t["installments_payments"]),
    "credit_card_balance": lambda t: summarise_credit_card(t["credit_card_balance"]),
    "pos_cash_balance": lambda t: summarise_pos_cash(t["pos_cash_balance"]),
}
