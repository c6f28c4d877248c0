"""Statements for features, history summaries and lookups."""

from __future__ import annotations

from oracles.bindings import with_tables


def total(value: str, places: int = 6) -> str:
    return f"round(sum({value}), {places})"


def mean(value: str, places: int = 7) -> str:
    return f"round(avg({value}), {places})"


def over(top: str, bottom: str) -> str:
    """Quotient, NULL for a zero divisor."""
    return f"(CASE WHEN {bottom} <> 0 THEN {top} / {bottom} END)"


def share(condition: str) -> str:
    return f"(CAST(count(CASE WHEN {condition} THEN 1 END) AS DOUBLE) / count(*))"


def tally(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


_TENURE = "CASE WHEN DAYS_EMPLOYED <> 365243 THEN DAYS_EMPLOYED END"
_GAPS = " + ".join(f"CASE WHEN EXT_SOURCE_{i} IS NULL THEN 1 ELSE 0 END" for i in (1, 2, 3))
_ZEROED = [f"coalesce(EXT_SOURCE_{i}, 0e0)" for i in (1, 2, 3)]
_ONED = [f"coalesce(EXT_SOURCE_{i}, 1e0)" for i in (1, 2, 3)]

DERIVED = f"""
  {over("AMT_CREDIT", "AMT_INCOME_TOTAL")} AS CREDIT_INCOME_RATIO,
  {over("AMT_ANNUITY", "AMT_INCOME_TOTAL")} AS ANNUITY_INCOME_RATIO,
  {over("AMT_ANNUITY", "AMT_CREDIT")} AS CREDIT_TERM,
  {over("AMT_CREDIT", "AMT_GOODS_PRICE")} AS CREDIT_GOODS_RATIO,
  {over("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS")} AS INCOME_PER_FAMILY_MEMBER,
  {over("AMT_INCOME_TOTAL", "(CNT_CHILDREN + 1)")} AS INCOME_PER_CHILD,
  -DAYS_BIRTH / 365.25e0 AS AGE_YEARS,
  -({_TENURE}) / 365.25e0 AS YEARS_EMPLOYED,
  {over("(" + _TENURE + ")", "DAYS_BIRTH")} AS EMPLOYED_LIFE_FRACTION,
  CAST(DAYS_EMPLOYED = 365243 AS INTEGER) AS FLAG_NOT_EMPLOYED,
  -DAYS_REGISTRATION / 365.25e0 AS YEARS_REGISTERED,
  -DAYS_ID_PUBLISH / 365.25e0 AS YEARS_SINCE_ID_PUBLISH,
  {over("(" + " + ".join(_ZEROED) + ")", "(3 - (" + _GAPS + "))")} AS EXT_SOURCE_MEAN,
  least({", ".join(_ONED)}) AS EXT_SOURCE_MIN,
  greatest({", ".join(_ZEROED)}) AS EXT_SOURCE_MAX,
  {" * ".join(_ZEROED)} AS EXT_SOURCE_PRODUCT,
  CAST({_GAPS} AS INTEGER) AS EXT_SOURCE_MISSING_COUNT"""

_LATE = "(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT)"
_SHORT = "(AMT_INSTALMENT - AMT_PAYMENT)"
_USE = over("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL")

SUMMARIES = {
    "agg_bureau": f"""SELECT SK_ID_CURR, count(*) AS BUR_COUNT,
      {tally("CREDIT_ACTIVE = 'Active'")} AS BUR_ACTIVE_COUNT,
      {tally("CREDIT_ACTIVE = 'Closed'")} AS BUR_CLOSED_COUNT,
      {share("CREDIT_ACTIVE = 'Active'")} AS BUR_ACTIVE_RATIO,
      count(DISTINCT CREDIT_TYPE) AS BUR_CREDIT_TYPES,
      {total("AMT_CREDIT_SUM")} AS BUR_CREDIT_SUM_TOTAL, {mean("AMT_CREDIT_SUM")} AS BUR_CREDIT_SUM_MEAN,
      max(AMT_CREDIT_SUM) AS BUR_CREDIT_SUM_MAX, {total("AMT_CREDIT_SUM_DEBT")} AS BUR_DEBT_TOTAL,
      {over(total("AMT_CREDIT_SUM_DEBT"), total("AMT_CREDIT_SUM"))} AS BUR_DEBT_CREDIT_RATIO,
      {total("AMT_CREDIT_SUM_OVERDUE")} AS BUR_OVERDUE_TOTAL,
      max(AMT_CREDIT_MAX_OVERDUE) AS BUR_MAX_OVERDUE_EVER, max(CREDIT_DAY_OVERDUE) AS BUR_DAYS_OVERDUE_MAX,
      {tally("CREDIT_DAY_OVERDUE > 0")} AS BUR_OVERDUE_COUNT,
      CAST(sum(CNT_CREDIT_PROLONG) AS BIGINT) AS BUR_PROLONG_TOTAL,
      min(DAYS_CREDIT) AS BUR_DAYS_CREDIT_MIN, max(DAYS_CREDIT) AS BUR_DAYS_CREDIT_MAX,
      avg(DAYS_CREDIT) AS BUR_DAYS_CREDIT_MEAN, max(DAYS_CREDIT_UPDATE) AS BUR_LAST_UPDATE,
      {mean("AMT_ANNUITY")} AS BUR_ANNUITY_MEAN
    FROM bureau GROUP BY SK_ID_CURR""",
    "agg_bureau_balance": f"""SELECT SK_ID_CURR, count(*) AS BURBAL_MONTHS,
      {tally("STATUS >= '1' AND STATUS <= '5'")} AS BURBAL_DPD_MONTHS,
      {share("STATUS >= '1' AND STATUS <= '5'")} AS BURBAL_DPD_RATIO,
      max(TRY_CAST(STATUS AS INTEGER)) AS BURBAL_WORST_STATUS,
      {share("STATUS = 'C'")} AS BURBAL_CLOSED_RATIO, min(MONTHS_BALANCE) AS BURBAL_OLDEST_MONTH
    FROM bureau JOIN bureau_balance USING (SK_ID_BUREAU) GROUP BY SK_ID_CURR""",
    "agg_previous_application": f"""SELECT SK_ID_CURR, count(*) AS PREV_COUNT,
      {tally("NAME_CONTRACT_STATUS = 'Approved'")} AS PREV_APPROVED,
      {tally("NAME_CONTRACT_STATUS = 'Refused'")} AS PREV_REFUSED,
      {share("NAME_CONTRACT_STATUS = 'Refused'")} AS PREV_REFUSAL_RATE,
      {share("NAME_CONTRACT_STATUS = 'Canceled'")} AS PREV_CANCEL_RATE,
      {mean("AMT_APPLICATION")} AS PREV_APPLICATION_MEAN, {mean("AMT_CREDIT")} AS PREV_CREDIT_MEAN,
      {mean(over("AMT_CREDIT", "AMT_APPLICATION"), 9)} AS PREV_GRANTED_RATIO,
      {mean("AMT_DOWN_PAYMENT")} AS PREV_DOWNPAYMENT_MEAN, avg(CNT_PAYMENT) AS PREV_TERM_MEAN,
      max(DAYS_DECISION) AS PREV_LAST_DECISION, min(DAYS_DECISION) AS PREV_FIRST_DECISION,
      count(DISTINCT CASE WHEN CODE_REJECT_REASON NOT IN ('XAP', 'XNA') THEN CODE_REJECT_REASON END)
        AS PREV_REJECT_REASONS
    FROM previous_application GROUP BY SK_ID_CURR""",
    "agg_installments": f"""SELECT SK_ID_CURR, count(*) AS INST_COUNT,
      avg({_LATE}) AS INST_DAYS_LATE_MEAN, max({_LATE}) AS INST_DAYS_LATE_MAX,
      {share(_LATE + " > 0")} AS INST_LATE_RATIO, {share(_LATE + " > 30")} AS INST_LATE_30D_RATIO,
      {mean(_SHORT)} AS INST_SHORTFALL_MEAN, {total(_SHORT)} AS INST_SHORTFALL_TOTAL,
      max({_SHORT}) AS INST_SHORTFALL_MAX, {share("AMT_PAYMENT < AMT_INSTALMENT")} AS INST_UNDERPAID_RATIO,
      {over(total("AMT_PAYMENT"), total("AMT_INSTALMENT"))} AS INST_PAYMENT_RATIO,
      max(DAYS_INSTALMENT) AS INST_LAST_DUE
    FROM installments_payments GROUP BY SK_ID_CURR""",
    "agg_credit_card": f"""SELECT SK_ID_CURR, count(*) AS CC_MONTHS, count(DISTINCT SK_ID_PREV) AS CC_CARDS,
      {mean("AMT_BALANCE")} AS CC_BALANCE_MEAN, max(AMT_BALANCE) AS CC_BALANCE_MAX,
      {mean(_USE, 9)} AS CC_UTILISATION_MEAN, max({_USE}) AS CC_UTILISATION_MAX,
      {mean("AMT_DRAWINGS_CURRENT")} AS CC_DRAWINGS_MEAN, avg(CNT_DRAWINGS_CURRENT) AS CC_DRAWINGS_COUNT_MEAN,
      max(SK_DPD) AS CC_DPD_MAX, {share("SK_DPD > 0")} AS CC_DPD_RATIO
    FROM credit_card_balance GROUP BY SK_ID_CURR""",
    "agg_pos_cash": f"""SELECT SK_ID_CURR, count(*) AS POS_MONTHS, count(DISTINCT SK_ID_PREV) AS POS_CONTRACTS,
      max(SK_DPD) AS POS_DPD_MAX, avg(SK_DPD) AS POS_DPD_MEAN, {share("SK_DPD > 0")} AS POS_DPD_RATIO,
      max(SK_DPD_DEF) AS POS_DPD_DEF_MAX, avg(CNT_INSTALMENT_FUTURE) AS POS_REMAINING_MEAN,
      min(MONTHS_BALANCE) AS POS_OLDEST_MONTH
    FROM pos_cash_balance GROUP BY SK_ID_CURR""",
}

HISTORY = (
    "bureau",
    "bureau_balance",
    "previous_application",
    "installments_payments",
    "credit_card_balance",
    "pos_cash_balance",
)
_JOINED = " ".join(f"LEFT JOIN {name} USING (SK_ID_CURR)" for name in SUMMARIES)

#: Named subqueries that end in ``matrix``, the wide feature table of the labelled applicants.
MATRIX = SUMMARIES | {"matrix": f"SELECT *, {DERIVED} FROM application_train {_JOINED}"}

_SPINE = {
    "spine": """SELECT *, 'application_train' AS SOURCE_TABLE FROM application_train
      WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM credit_card_balance)
      UNION ALL BY NAME
      SELECT *, 'application_test' AS SOURCE_TABLE FROM application_test
      WHERE SK_ID_CURR NOT IN (SELECT SK_ID_CURR FROM application_train)"""
}

STATEMENTS: dict[str, str] = {
    "derived_features": with_tables(f"SELECT SK_ID_CURR, {DERIVED} FROM application_train", "application_train"),
    "agg_bureau": with_tables(SUMMARIES["agg_bureau"], "bureau"),
    "agg_bureau_balance": with_tables(SUMMARIES["agg_bureau_balance"], "bureau", "bureau_balance"),
    "agg_previous_application": with_tables(SUMMARIES["agg_previous_application"], "previous_application"),
    "agg_installments": with_tables(SUMMARIES["agg_installments"], "installments_payments"),
    "agg_credit_card": with_tables(SUMMARIES["agg_credit_card"], "credit_card_balance"),
    "agg_pos_cash": with_tables(SUMMARIES["agg_pos_cash"], "pos_cash_balance"),
    "feature_matrix": with_tables("SELECT * FROM matrix", "application_train", *HISTORY, extra=MATRIX),
    "applicant_lookup": with_tables(
        f"SELECT *, {DERIVED} FROM spine {_JOINED}",
        "application_train",
        "application_test",
        *HISTORY,
        extra=SUMMARIES | _SPINE,
    ),
}
