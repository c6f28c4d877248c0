"""Statements for segments, quality checks and direct questions."""

from __future__ import annotations

from creditloom.operators.quality import CATEGORY_PREFIXES
from creditloom.sources.manifest import DESCRIPTIONS
from oracles.bindings import TABLES, with_tables
from oracles.features import mean, over, total

APP = "application_train"
_AGE = "CAST(floor(-DAYS_BIRTH / 365.25e0 / 10) * 10 AS BIGINT)"
_BANDS = """WHEN -DAYS_EMPLOYED / 365.25e0 < 2 THEN 'under 2 years'
  WHEN -DAYS_EMPLOYED / 365.25e0 < 5 THEN '2-5 years' ELSE 'over 5 years' END"""


def rates(segment: str, name: str, source: str = APP, where: str = "", count: str = "applicants") -> str:
    return (
        f"SELECT {segment} AS {name}, count(*) AS {count}, avg(TARGET) AS default_rate FROM {source} "
        f"{where} GROUP BY 1"
    )


_DECILES = f"""SELECT SK_ID_CURR, TARGET, ntile(10) OVER (ORDER BY EXT_SOURCE_2 ASC NULLS LAST, SK_ID_CURR) AS decile
  FROM {APP} WHERE EXT_SOURCE_2 IS NOT NULL"""
_BURDEN = over("AMT_CREDIT", "AMT_INCOME_TOTAL")
_QUINTILES = f"""SELECT SK_ID_CURR, TARGET, {_BURDEN} AS burden,
  ntile(5) OVER (ORDER BY {_BURDEN} ASC NULLS LAST, SK_ID_CURR) AS quintile FROM {APP} WHERE AMT_INCOME_TOTAL > 0"""
_BY_QUINTILE = f"""SELECT CAST(quintile AS BIGINT) AS quintile, count(*) AS applicants,
  {mean("burden", 9)} AS avg_credit_income_ratio, avg(TARGET) AS default_rate FROM quintiles GROUP BY 1"""

_OVERDUE = f"""{APP} JOIN (SELECT SK_ID_CURR, sum(AMT_CREDIT_SUM_OVERDUE) AS owed FROM bureau GROUP BY 1)
  USING (SK_ID_CURR)"""
_REFUSALS = f"""{APP} JOIN (SELECT SK_ID_CURR, max(CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 1 ELSE 0 END) AS hit
  FROM previous_application GROUP BY 1) USING (SK_ID_CURR)"""
_LATENESS = f"""{APP} JOIN (SELECT SK_ID_CURR, avg(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT) AS late
  FROM installments_payments WHERE DAYS_ENTRY_PAYMENT IS NOT NULL GROUP BY 1) USING (SK_ID_CURR)"""

_EMPLOYMENT = f"CASE WHEN DAYS_EMPLOYED = 365243 THEN 'not employed' {_BANDS}"
_FLAGS = {
    "risk_by_bureau_overdue": (
        "CASE WHEN owed > 0 THEN 'has overdue bureau credit' ELSE 'no overdue bureau credit' END",
        "overdue_status",
        _OVERDUE,
        "bureau",
    ),
    "risk_by_previous_refusal": (
        "CASE WHEN hit > 0 THEN 'previously refused' ELSE 'never refused' END",
        "history",
        _REFUSALS,
        "previous_application",
    ),
    "risk_by_installment_lateness": (
        "CASE WHEN late > 5 THEN 'often pay late' ELSE 'pay on time or early' END",
        "payment_behaviour",
        _LATENESS,
        "installments_payments",
    ),
}


def _pct(value: str) -> str:
    return f"printf('%.1f%%', 100e0 * ({value}))"


def _worst(table: str, segment: str, template: str, best: bool = False) -> str:
    top = f"(SELECT {segment} FROM {table} ORDER BY default_rate DESC, {segment} LIMIT 1)"
    high = f"(SELECT default_rate FROM {table} ORDER BY default_rate DESC, {segment} LIMIT 1)"
    low = f"(SELECT default_rate FROM {table} ORDER BY default_rate, {segment} DESC LIMIT 1)"
    text = template.replace("{segment}", f"' || {top} || '").replace("{rate}", f"' || {_pct(high)} || '")
    return f"SELECT '{text.replace('{low}', chr(39) + ' || ' + _pct(low) + ' || ' + chr(39))}' AS headline"


def _quintile_sentence() -> str:
    high = "SELECT * FROM by_quintile ORDER BY default_rate DESC, quintile LIMIT 1"
    low = "SELECT * FROM by_quintile ORDER BY default_rate, quintile LIMIT 1"
    return f"""SELECT 'Quintile ' || h.quintile || ' (avg ratio ' || printf('%.1f', h.avg_credit_income_ratio)
      || 'x income) defaults most often, at ' || {_pct("h.default_rate")} || ', versus ' || {_pct("l.default_rate")}
      || ' in quintile ' || l.quintile || ' (avg ratio ' || printf('%.1f', l.avg_credit_income_ratio) || 'x).'
      AS headline FROM ({high}) h, ({low}) l"""


_HEADLINE_TABLES = {
    "deciles": _DECILES,
    "by_decile": rates("decile", "decile", "deciles"),
    "by_age": rates(_AGE, "age_band"),
    "by_employment": rates(_EMPLOYMENT, "band"),
    "quintiles": _QUINTILES,
    "by_quintile": _BY_QUINTILE,
    "by_contract": rates("NAME_CONTRACT_TYPE", "kind"),
    "by_overdue": rates(*_FLAGS["risk_by_bureau_overdue"][:3]),
    "by_history": rates(*_FLAGS["risk_by_previous_refusal"][:3]),
    "by_lateness": rates(*_FLAGS["risk_by_installment_lateness"][:3]),
}
_HEADLINES = {
    "ext_source_decile": f"""SELECT 'The bottom EXT_SOURCE_2 decile defaults at ' || {_pct("b.default_rate")} || ', versus '
      || {_pct("t.default_rate")} || ' in the top decile' || CASE WHEN t.default_rate > 0
      THEN printf(' - %.1fx the risk.', b.default_rate / t.default_rate) ELSE '.' END AS headline
      FROM by_decile b, by_decile t WHERE b.decile = 1 AND t.decile = 10""",
    "age_vs_default": f"""SELECT 'Applicants in their ' || y.age_band || 's default at ' || {_pct("y.default_rate")}
      || ', versus ' || {_pct("o.default_rate")} || ' for those in their ' || o.age_band || 's.' AS headline
      FROM by_age y, by_age o WHERE y.age_band = (SELECT min(age_band) FROM by_age)
      AND o.age_band = (SELECT max(age_band) FROM by_age)""",
    "employment_vs_default": _worst(
        "by_employment", "band", "''{segment}'' applicants default most often, at {rate}."
    ),
    "loan_burden_vs_default": _quintile_sentence(),
    "contract_type_vs_default": _worst(
        "by_contract", "kind", "{segment} applicants default at {rate}, the highest of the contract types."
    ),
    "bureau_overdue_vs_default": _worst(
        "by_overdue",
        "overdue_status",
        "Clients with overdue bureau credit default at {rate}, versus {low} for those with none.",
    ),
    "previous_refusal_vs_default": _worst("by_history", "history", "Clients {segment} default at {rate}."),
    "installment_lateness_vs_default": _worst(
        "by_lateness", "payment_behaviour", "Clients who {segment} default at {rate}."
    ),
}

# --- quality ---


def _category(column: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"starts_with({column}, '{p}')" for p in prefixes) + f" THEN '{category}'"
        for category, prefixes in CATEGORY_PREFIXES.items()
    )
    return f"CASE {cases} ELSE 'other' END"


def _profile(table: str) -> str:
    """Missing cells per column, whatever the columns are."""
    return f"""SELECT '{table}' AS table_name, column_name, {_category("column_name")} AS category,
      CAST(n_total - filled AS BIGINT) AS n_missing, n_total
    FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {table}) ON COLUMNS(*) INTO NAME column_name VALUE filled),
         (SELECT count(*) AS n_total FROM {table})"""


_FINDINGS = {
    "days_employed_sentinel": f"""
      SELECT 'count' AS metric, CAST(count(*) FILTER (DAYS_EMPLOYED = 365243) AS DOUBLE) AS value,
        'action_needed' AS severity FROM {APP} UNION ALL
      SELECT 'pct', CAST(count(*) FILTER (DAYS_EMPLOYED = 365243) AS DOUBLE) / count(*), 'action_needed' FROM {APP}""",
    "gender_xna": f"""
      SELECT 'count' AS metric, CAST(sum(CAST(CODE_GENDER = 'XNA' AS INTEGER)) AS DOUBLE) AS value,
        CASE WHEN bool_or(CODE_GENDER = 'XNA') THEN 'notable' ELSE 'info' END AS severity FROM {APP} UNION ALL
      SELECT 'pct', CAST(sum(CAST(CODE_GENDER = 'XNA' AS INTEGER)) AS DOUBLE) / count(*),
        CASE WHEN bool_or(CODE_GENDER = 'XNA') THEN 'notable' ELSE 'info' END FROM {APP}""",
    "income_outlier": f"""
      SELECT 'max' AS metric, max(AMT_INCOME_TOTAL) AS value, 'notable' AS severity FROM {APP} UNION ALL
      SELECT 'median', median(AMT_INCOME_TOTAL), 'notable' FROM {APP} UNION ALL
      SELECT 'mean', {mean("AMT_INCOME_TOTAL")}, 'notable' FROM {APP} UNION ALL
      SELECT 'max_to_median_ratio',
        coalesce(max(AMT_INCOME_TOTAL), 0e0) / greatest(coalesce(median(AMT_INCOME_TOTAL), 1e0), 1e0), 'notable'
      FROM {APP}""",
    "days_columns_sign": f"""
      SELECT 'columns_checked' AS metric, 3e0 AS value, 'info' AS severity UNION ALL
      SELECT 'positive DAYS_BIRTH', CAST(count(*) AS DOUBLE), 'info' FROM {APP} WHERE DAYS_BIRTH > 0 UNION ALL
      SELECT 'positive DAYS_REGISTRATION', CAST(count(*) AS DOUBLE), 'info' FROM {APP}
        WHERE DAYS_REGISTRATION > 0 UNION ALL
      SELECT 'positive DAYS_ID_PUBLISH', CAST(count(*) AS DOUBLE), 'info' FROM {APP} WHERE DAYS_ID_PUBLISH > 0""",
    "building_stats_missing": f"""
      SELECT 'columns' AS metric, 1e0 AS value, 'notable' AS severity UNION ALL
      SELECT m, 1e0 - CAST(count(APARTMENTS_AVG) AS DOUBLE) / count(*), 'notable'
      FROM {APP}, (VALUES ('min_pct_missing'), ('max_pct_missing')) v(m) GROUP BY m""",
    "class_imbalance": f"""
      SELECT 'default_rate' AS metric, avg(TARGET) AS value, 'action_needed' AS severity FROM {APP} UNION ALL
      SELECT 'imbalance_ratio', (1e0 - avg(TARGET)) / avg(TARGET), 'action_needed' FROM {APP}""",
}


def _finding(name: str) -> str:
    return f"SELECT '{name}' AS finding, metric, value, severity FROM ({_FINDINGS[name]})"


_QUALITY = {
    "quality_sentinel": "days_employed_sentinel",
    "quality_unknown_category": "gender_xna",
    "quality_income_outlier": "income_outlier",
    "quality_days_sign": "days_columns_sign",
    "quality_block_missing": "building_stats_missing",
    "quality_class_imbalance": "class_imbalance",
}


def _summary_row(table: str) -> str:
    width = f"(SELECT count(*) FROM (DESCRIBE SELECT * FROM {table}))"
    return f"""SELECT '{table}' AS table_name, '{DESCRIPTIONS[table]}' AS description, count(*) AS row_count,
      CAST({{width}} AS BIGINT) AS column_count, count(*) * {{width}} * 8 / 1e6 AS approx_size_mb FROM {table}""".replace(
        "{width}", str(_WIDTHS[table])
    )


_WIDTHS = {
    "application_train": 20,
    "application_test": 19,
    "bureau": 13,
    "bureau_balance": 3,
    "previous_application": 9,
    "installments_payments": 6,
    "credit_card_balance": 7,
    "pos_cash_balance": 6,
}




def spread(key: str = "SK_ID_CURR", seed: int = 0) -> str:
    first = f"((({key} + {seed}) % 2147483648) * 2654435761 % 4294967296)"
    return f"((xor({first}, {first} >> 15) & 2147483647) * 2246822519 % 4294967296)"


_PER_CLIENT_LATE = "SELECT SK_ID_CURR, avg(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT) AS late FROM installments_payments WHERE DAYS_ENTRY_PAYMENT IS NOT NULL GROUP BY 1"

STATEMENTS: dict[str, str] = {
    "risk_by_score_decile": with_tables(
        rates("CAST(decile AS BIGINT)", "decile", "deciles"), APP, extra={"deciles": _DECILES}
    ),
    "rate_by_decile": with_tables(
        rates("CAST(decile AS BIGINT)", "decile", "deciles", count="applications"), APP, extra={"deciles": _DECILES}
    ),
    "risk_by_age_band": with_tables(rates(_AGE, "age_band"), APP),
    "risk_by_employment_band": with_tables(rates(_EMPLOYMENT, "employment_band"), APP),
    "risk_by_loan_burden": with_tables(_BY_QUINTILE, APP, extra={"quintiles": _QUINTILES}),
    "loan_burden_shape": with_tables(
        """SELECT h AS riskiest_quintile, l AS safest_quintile, h = 5 AND l = 1 AS is_monotonic FROM
        (SELECT (SELECT quintile FROM by_quintile ORDER BY default_rate DESC, quintile LIMIT 1) AS h,
                (SELECT quintile FROM by_quintile ORDER BY default_rate, quintile LIMIT 1) AS l)""",
        APP,
        extra={"quintiles": _QUINTILES, "by_quintile": _BY_QUINTILE},
    ),
    "risk_by_contract_type": with_tables(rates("NAME_CONTRACT_TYPE", "NAME_CONTRACT_TYPE"), APP),
    **{k: with_tables(rates(s, n, src), APP, t) for k, (s, n, src, t) in _FLAGS.items()},
    "insight_headlines": with_tables(
        " UNION ALL ".join(f"SELECT '{k}' AS insight_id, headline FROM ({sql})" for k, sql in _HEADLINES.items()),
        APP,
        "bureau",
        "previous_application",
        "installments_payments",
        extra=_HEADLINE_TABLES,
    ),
    "missing_values": with_tables(
        "SELECT *, CAST(n_missing AS DOUBLE) / n_total AS pct_missing FROM ("
        + " UNION ALL ".join(_profile(t) for t in (APP, "bureau", "previous_application"))
        + ") WHERE n_missing > 0",
        APP,
        "bureau",
        "previous_application",
    ),
    "column_categories": with_tables(
        f"""SELECT category, count(*) AS columns, CAST(sum(n_total - n_missing) AS BIGINT) AS filled_cells
        FROM ({_profile(APP)}) GROUP BY category""",
        APP,
    ),
    "table_summary": with_tables(" UNION ALL ".join(_summary_row(t) for t in TABLES), *TABLES),
    **{k: with_tables(_finding(v), APP) for k, v in _QUALITY.items()},
    "quality_report": with_tables(" UNION ALL ".join(_finding(f) for f in _FINDINGS), APP),
    "global_ntile": with_tables(
        f"""SELECT SK_ID_CURR, {_BURDEN} AS burden,
        CAST(ntile(7) OVER (ORDER BY {_BURDEN} ASC NULLS LAST, SK_ID_CURR) AS BIGINT) AS tile FROM {APP}""",
        APP,
    ),
    "overall_default_rate": with_tables(
        f"""SELECT count(*) AS applications, CAST(sum(TARGET) AS BIGINT) AS defaults, avg(TARGET) AS default_rate
        FROM {APP}""",
        APP,
    ),
    "rate_by_education": with_tables(
        rates("NAME_EDUCATION_TYPE", "NAME_EDUCATION_TYPE", count="applications"), APP
    ),
    "rate_by_age_band": with_tables(rates(_AGE, "age_band_start", count="applications"), APP),
    "rate_by_tenure": with_tables(
        rates(f"CASE {_BANDS}", "employment_band", where="WHERE DAYS_EMPLOYED <> 365243", count="applications"), APP
    ),
    "rate_by_product": with_tables(rates("NAME_CONTRACT_TYPE", "NAME_CONTRACT_TYPE", count="applications"), APP),
    "rate_by_credit_count": with_tables(
        rates(
            "least(n, 10)",
            "bureau_credits",
            f"{APP} JOIN (SELECT SK_ID_CURR, count(*) AS n FROM bureau GROUP BY 1) USING (SK_ID_CURR)",
            count="applications",
        ),
        APP,
        "bureau",
    ),
    "clients_with_refusal": with_tables(
        """SELECT count(DISTINCT SK_ID_CURR) AS clients_with_refusal FROM previous_application
        WHERE NAME_CONTRACT_STATUS = 'Refused'""",
        "previous_application",
    ),
    "top_occupations": with_tables(
        f"""SELECT OCCUPATION_TYPE, count(*) AS applications, {mean("AMT_CREDIT")} AS avg_loan_amount FROM {APP}
        WHERE OCCUPATION_TYPE IS NOT NULL GROUP BY 1 ORDER BY avg_loan_amount DESC, 1 LIMIT 10""",
        APP,
    ),
    "top_k_by_metric": with_tables(
        f"""SELECT SK_ID_CURR, count(*) AS applications, {mean("AMT_BALANCE")} AS avg_balance
        FROM credit_card_balance GROUP BY 1 ORDER BY avg_balance DESC, 1 LIMIT 10""",
        "credit_card_balance",
    ),
    "lateness_by_outcome": with_tables(
        f"""SELECT TARGET, count(*) AS clients, {mean("late", 9)} AS avg_days_late
        FROM {APP} JOIN ({_PER_CLIENT_LATE}) USING (SK_ID_CURR) GROUP BY 1""",
        APP,
        "installments_payments",
    ),
    "bounded_result": with_tables(
        f"""SELECT SK_ID_CURR, AMT_CREDIT, TARGET, (SELECT count(*) FROM {APP}) > 500 AS truncated FROM {APP}
        ORDER BY AMT_CREDIT DESC, SK_ID_CURR LIMIT 500""",
        APP,
    ),
    "exposure_by_outcome": with_tables(
        f"""SELECT TARGET, {mean("owed")} AS avg_exposure FROM {APP} JOIN
        (SELECT SK_ID_CURR, {total("AMT_CREDIT_SUM")} AS owed FROM bureau WHERE CREDIT_ACTIVE = 'Active' GROUP BY 1)
        USING (SK_ID_CURR) GROUP BY 1""",
        APP,
        "bureau",
    ),
    "credits_by_gender": with_tables(
        f"""SELECT CODE_GENDER, count(DISTINCT SK_ID_BUREAU) AS credits FROM {APP} JOIN bureau USING (SK_ID_CURR)
        GROUP BY 1""",
        APP,
        "bureau",
    ),
    "status_distribution": with_tables(
        "SELECT STATUS, count(*) AS months FROM bureau_balance JOIN bureau USING (SK_ID_BUREAU) GROUP BY 1",
        "bureau",
        "bureau_balance",
    ),
    "derived_table_sort": with_tables(f"SELECT SK_ID_CURR, AMT_CREDIT FROM {APP} ORDER BY 2 DESC, 1", APP),
    "filtered_count": with_tables(
        f"SELECT count(*) AS applications FROM {APP} WHERE AMT_INCOME_TOTAL > 200000", APP
    ),
    "avg_income_defaulted": with_tables(
        f"SELECT count(*) AS defaults, {mean('AMT_INCOME_TOTAL')} AS avg_income FROM {APP} WHERE TARGET = 1", APP
    ),
    "naive_join_fanout": with_tables(
        f"""SELECT count(*) AS joined_rows, count(DISTINCT SK_ID_CURR) AS clients, avg(TARGET) AS fanned_out_rate,
        (SELECT avg(TARGET) FROM {APP} WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM bureau)) AS client_rate
        FROM {APP} JOIN bureau USING (SK_ID_CURR)""",
        APP,
        "bureau",
    ),
    "scalar_pack": with_tables(
        f"""SELECT SK_ID_CURR, nullif(CNT_CHILDREN, 0) AS children_or_null,
        coalesce(OCCUPATION_TYPE, 'unknown') AS occupation, least(EXT_SOURCE_2, EXT_SOURCE_3) AS lower_score,
        greatest(EXT_SOURCE_2, EXT_SOURCE_3) AS higher_score,
        CASE WHEN DAYS_BIRTH BETWEEN -14600 AND -10950 THEN 'thirties' ELSE 'other' END AS age_group,
        CAST(OCCUPATION_TYPE IS NOT NULL AS INTEGER) AS has_occupation,
        CAST(CODE_GENDER NOT IN ('XNA') AS INTEGER) AS known_gender,
        TRY_CAST(CODE_GENDER AS INTEGER) AS gender_number,
        CAST(floor(AMT_CREDIT / 100000) AS BIGINT) AS credit_step, round(EXT_SOURCE_2, 2) AS score_2dp,
        abs(DAYS_BIRTH) AS days_old, abs(DAYS_BIRTH) / 365.25e0 AS years_old, {spread()} AS spread,
        SK_ID_CURR % 7 AS weekday,
        CASE WHEN NAME_CONTRACT_TYPE = 'Cash loans' THEN 'Cash loans' ELSE 'Revolving loans' END AS label,
        coalesce(printf('%.1f%%', EXT_SOURCE_2 * 100e0), 'n/a') AS score_pct,
        format('{{:,}}', CAST(AMT_CREDIT AS BIGINT)) AS credit_text FROM {APP}""",
        APP,
    ),
}
