"""The logical credit tables as SQL common table expressions over the generated tables."""

from __future__ import annotations

_DAY = "date_diff('day', DATE '2001-11-05', CAST(o_orderdate AS DATE))"


def _applicants(shift: int, label: str) -> str:
    return f"""
    SELECT c_custkey + {shift} AS SK_ID_CURR, {label}
      CASE WHEN c_custkey % 10 = 0 THEN 'Revolving loans' ELSE 'Cash loans' END AS NAME_CONTRACT_TYPE,
      CASE WHEN c_custkey % 500 = 0 THEN 'XNA' WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'F' END AS CODE_GENDER,
      c_mktsegment AS NAME_EDUCATION_TYPE,
      CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS OCCUPATION_TYPE,
      CAST(c_custkey % 4 AS BIGINT) AS CNT_CHILDREN,
      CAST(c_custkey % 5 AS DOUBLE) AS CNT_FAM_MEMBERS,
      CASE WHEN c_custkey % 211 = 0 THEN 0e0 WHEN c_custkey % 50 = 0 THEN NULL
           ELSE 30000e0 + 20e0 * abs(c_acctbal) END AS AMT_INCOME_TOTAL,
      50000e0 + (7919 * c_custkey % 1000) * 900 AS AMT_CREDIT,
      CASE WHEN c_custkey % 89 <> 0
           THEN (50000e0 + (7919 * c_custkey % 1000) * 900) / (10 + c_custkey % 20) END AS AMT_ANNUITY,
      CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 101 = 0 THEN 0e0
           ELSE 45000e0 + (7919 * c_custkey % 1000) * 850 END AS AMT_GOODS_PRICE,
      CAST(-(7300 + 31 * c_custkey % 18000) AS BIGINT) AS DAYS_BIRTH,
      CAST(CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -(17 * c_custkey % 9000) END AS BIGINT) AS DAYS_EMPLOYED,
      CAST(-(13 * c_custkey % 12000) AS DOUBLE) AS DAYS_REGISTRATION,
      CAST(-(11 * c_custkey % 6000) AS BIGINT) AS DAYS_ID_PUBLISH,
      CASE WHEN c_custkey % 2 <> 0 THEN (37 * c_custkey % 1000) / 1000e0 END AS EXT_SOURCE_1,
      CASE WHEN c_custkey % 450 <> 0
           THEN 0.5e0 * (c_acctbal + 1000) / 11000e0 + 0.5e0 * (41 * c_custkey % 1000) / 1000e0 END AS EXT_SOURCE_2,
      CASE WHEN c_custkey % 5 <> 0 THEN (43 * c_custkey % 1000) / 1000e0 END AS EXT_SOURCE_3,
      CASE WHEN c_custkey % 9 >= 5 THEN c_nationkey / 25e0 END AS APARTMENTS_AVG
    FROM customer"""


TABLES: dict[str, str] = {
    "application_train": _applicants(0, "CAST(c_acctbal < 0 AS BIGINT) AS TARGET,"),
    "application_test": _applicants(1000000, ""),
    "bureau": f"""
    SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Active' WHEN '2-HIGH' THEN 'Active' WHEN '5-LOW' THEN 'Sold'
           ELSE 'Closed' END AS CREDIT_ACTIVE,
      o_orderpriority AS CREDIT_TYPE, {_DAY} AS DAYS_CREDIT,
      CASE WHEN o_orderkey % 37 = 0 THEN o_orderkey % 90 ELSE 0 END AS CREDIT_DAY_OVERDUE,
      CASE WHEN o_orderkey % 3 <> 0 THEN 0.02e0 * o_totalprice END AS AMT_CREDIT_MAX_OVERDUE,
      o_orderkey % 3 AS CNT_CREDIT_PROLONG, o_totalprice AS AMT_CREDIT_SUM,
      CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice * (o_orderkey % 10) / 10e0 END AS AMT_CREDIT_SUM_DEBT,
      CASE WHEN o_orderkey % 40 = 0 THEN 0.01e0 * o_totalprice ELSE 0e0 END AS AMT_CREDIT_SUM_OVERDUE,
      {_DAY} + o_orderkey % 30 AS DAYS_CREDIT_UPDATE,
      CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 12e0 END AS AMT_ANNUITY
    FROM orders WHERE o_orderstatus = 'F'""",
    "bureau_balance": """
    SELECT l_orderkey AS SK_ID_BUREAU, CAST(-3 * l_linenumber AS BIGINT) AS MONTHS_BALANCE,
      CASE WHEN l_returnflag = 'A' THEN 'C' WHEN l_quantity < 5 THEN 'X' WHEN l_quantity < 30 THEN '0'
           ELSE CAST(1 + l_linenumber % 5 AS VARCHAR) END AS STATUS
    FROM lineitem""",
    "previous_application": f"""
    SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_PREV,
      CASE WHEN o_orderkey % 10 < 6 THEN 'Approved' WHEN o_orderkey % 10 < 8 THEN 'Refused'
           WHEN o_orderkey % 10 = 8 THEN 'Canceled' ELSE 'Unused offer' END AS NAME_CONTRACT_STATUS,
      CASE WHEN o_orderkey % 33 = 0 THEN 0e0 ELSE o_totalprice END AS AMT_APPLICATION,
      o_totalprice * (80 + o_orderkey % 40) / 100e0 AS AMT_CREDIT,
      CASE WHEN o_orderkey % 2 <> 0 THEN 0.1e0 * o_totalprice END AS AMT_DOWN_PAYMENT,
      CAST(6 + o_orderkey % 55 AS DOUBLE) AS CNT_PAYMENT, {_DAY} AS DAYS_DECISION,
      CASE o_orderkey % 5 WHEN 0 THEN 'XAP' WHEN 1 THEN 'XNA' WHEN 2 THEN 'HC' WHEN 3 THEN 'LIMIT' END
        AS CODE_REJECT_REASON
    FROM orders WHERE o_orderstatus = 'P'""",
    "installments_payments": f"""
    SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_PREV,
      CAST({_DAY} + 30 * l_linenumber AS DOUBLE) AS DAYS_INSTALMENT,
      CASE WHEN l_partkey % 200 <> 0
           THEN CAST({_DAY} + 30 * l_linenumber + l_partkey % 61 - 25 AS DOUBLE) END AS DAYS_ENTRY_PAYMENT,
      l_extendedprice AS AMT_INSTALMENT,
      CASE WHEN l_partkey % 200 = 0 THEN NULL WHEN l_linestatus = 'O' THEN l_extendedprice * (1e0 - l_discount)
           ELSE l_extendedprice END AS AMT_PAYMENT
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'""",
    "credit_card_balance": """
    SELECT user_id AS SK_ID_CURR, 10 * user_id + event_id % 3 AS SK_ID_PREV, 100e0 * value AS AMT_BALANCE,
      CASE WHEN event_type = 'signup' THEN 0 ELSE 5000 + 1000 * (event_id % 7) END AS AMT_CREDIT_LIMIT_ACTUAL,
      CASE WHEN event_type <> 'view' THEN value END AS AMT_DRAWINGS_CURRENT,
      event_id % 12 AS CNT_DRAWINGS_CURRENT,
      CASE WHEN event_type = 'error' THEN event_id % 45 ELSE 0 END AS SK_DPD
    FROM events""",
    "pos_cash_balance": """
    SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_PREV, CAST(-l_linenumber AS BIGINT) AS MONTHS_BALANCE,
      CASE WHEN l_partkey % 50 <> 0 THEN l_quantity END AS CNT_INSTALMENT_FUTURE,
      CASE WHEN l_partkey % 29 = 0 THEN l_partkey % 60 ELSE 0 END AS SK_DPD,
      CASE WHEN l_partkey % 58 = 0 THEN l_partkey % 15 ELSE 0 END AS SK_DPD_DEF
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'""",
}


def with_tables(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the logical tables it reads and any further named subqueries."""
    parts = {name: TABLES[name] for name in names} | (extra or {})
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items()) + "\n" + body
