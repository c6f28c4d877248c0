"""Statements for ingest, model preparation, linear attribution and rules."""

from __future__ import annotations

from oracles.bindings import TABLES, with_tables
from oracles.evaluation import _AUC, _FOLDED, _RANKED, _SCORED
from oracles.features import DERIVED, mean

APP = "application_train"
CATEGORICAL = ["NAME_CONTRACT_TYPE", "CODE_GENDER", "NAME_EDUCATION_TYPE", "OCCUPATION_TYPE"]
NUMERIC = [
    "CNT_CHILDREN",
    "CNT_FAM_MEMBERS",
    "DAYS_BIRTH",
    "DAYS_EMPLOYED",
    "DAYS_REGISTRATION",
    "DAYS_ID_PUBLISH",
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "AMT_GOODS_PRICE",
    "EXT_SOURCE_1",
    "EXT_SOURCE_2",
    "EXT_SOURCE_3",
    "APARTMENTS_AVG",
]
LINEAR = [
    "EXT_SOURCE_MEAN",
    "EXT_SOURCE_2",
    "CREDIT_INCOME_RATIO",
    "ANNUITY_INCOME_RATIO",
    "CREDIT_TERM",
    "AGE_YEARS",
    "YEARS_EMPLOYED",
    "CNT_CHILDREN",
]

# --- preparation: fitted on folds 2 to 5 ---

_TRAIN = {
    "ranked": _RANKED,
    "folded": _FOLDED,
    "training": f"SELECT * FROM {APP} WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM folded WHERE fold <> 1)",
}


def _code(column: str) -> str:
    return f"""(SELECT {column} AS v, dense_rank() OVER (ORDER BY {column}) - 1 AS code
      FROM (SELECT DISTINCT {column} FROM training WHERE {column} IS NOT NULL))"""


def _mode(column: str) -> str:
    return f"""(SELECT {column} FROM training WHERE {column} IS NOT NULL GROUP BY 1
      ORDER BY count(*) DESC, {column} LIMIT 1)"""


_IMPUTED = {
    "medians": "SELECT " + ", ".join(f"median(CAST({c} AS DOUBLE)) AS m_{c}" for c in NUMERIC) + " FROM training",
    "filled": "SELECT SK_ID_CURR, "
    + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in NUMERIC)
    + f" FROM {APP}, medians",
}
_ENCODED = "SELECT SK_ID_CURR, " + ", ".join(
    f"CAST(coalesce(t{i}.code, -1) AS DOUBLE) AS {c}_code" for i, c in enumerate(CATEGORICAL)
)
_EVERYONE = " UNION ALL ".join(
    f"SELECT SK_ID_CURR, {', '.join(CATEGORICAL)} FROM {t}" for t in (APP, "application_test")
)
_SCALE = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)


def _slots(column: str, value: str) -> str:
    return f"""SELECT '{column}' AS column_name, category, rows, is_frequent,
      CAST(CASE WHEN is_frequent THEN sum(CAST(is_frequent AS INTEGER)) OVER (ORDER BY category) - 1 ELSE 19 END
        AS BIGINT) AS slot
    FROM (SELECT category, rows, count(*) OVER () <= 20
        OR row_number() OVER (ORDER BY rows DESC, category DESC) < 20 AS is_frequent
      FROM (SELECT {value} AS category, count(*) AS rows FROM {APP} WHERE {value} IS NOT NULL GROUP BY 1))"""


# --- linear attribution ---

_PUSHES = {
    "enriched": f"SELECT *, {DERIVED} FROM {APP}",
    "fitted": "SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, regr_slope(TARGET, {c}) AS w_{c}" for c in LINEAR)
    + " FROM enriched",
    "pushes": " UNION ALL ".join(
        f"""SELECT SK_ID_CURR, '{c}' AS feature, CAST({c} AS DOUBLE) AS value,
        w_{c} * (coalesce(CAST({c} AS DOUBLE), m_{c}) - m_{c}) AS contribution FROM enriched, fitted"""
        for c in LINEAR
    ),
    "placed": """SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY abs(contribution) DESC, feature) AS place
      FROM pushes""",
}
_LABEL = "upper(substr(feature, 1, 1)) || lower(replace(substr(feature, 2), '_', ' '))"

# --- rules ---

_RULED = f"""SELECT TARGET AS y, 1e0 - EXT_SOURCE_2 AS p,
    CASE WHEN EXT_SOURCE_MEAN <= 0.4e0 AND CREDIT_INCOME_RATIO > 3 THEN 0 WHEN EXT_SOURCE_MEAN <= 0.4e0 THEN 1
      WHEN EXT_SOURCE_MEAN > 0.4e0 AND AGE_YEARS <= 40 THEN 2 ELSE 3 END AS leaf
  FROM (SELECT TARGET, EXT_SOURCE_2, {DERIVED} FROM {APP} WHERE EXT_SOURCE_2 IS NOT NULL)"""
_RULES = f"""SELECT leaf, CASE leaf WHEN 0 THEN 'Ext source mean <= 0.4 AND Credit income ratio > 3'
      WHEN 1 THEN 'Ext source mean <= 0.4' WHEN 2 THEN 'Ext source mean > 0.4 AND Age years <= 40' ELSE '' END AS conditions,
    count(*) AS n_applicants, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ruled) AS population_share,
    avg(y) AS observed_default_rate, avg(y) / (SELECT avg(y) FROM ruled) AS lift_over_base_rate,
    {mean("p", 9)} AS mean_predicted_score FROM ruled GROUP BY leaf"""

_CSV = (
    "application_train",
    "application_test",
    "bureau",
    "bureau_balance",
    "previous_application",
    "installments_payments",
    "credit_card_balance",
    "pos_cash_balance",
)
_LOADED_FROM = {
    "application_train": "customer",
    "application_test": "customer",
    "bureau": "orders",
    "bureau_balance": "lineitem",
    "previous_application": "orders",
    "installments_payments": "lineitem",
    "credit_card_balance": "events",
    "pos_cash_balance": "lineitem",
}

STATEMENTS: dict[str, str] = {
    "csv_scan": with_tables(f"SELECT * FROM {APP}", APP),
    "load_table": with_tables(
        "SELECT * FROM previous_application WHERE NAME_CONTRACT_STATUS = 'Refused'", "previous_application"
    ),
    "ingest_rowcount_audit": with_tables(
        "SELECT *, expected_rows = actual_rows AS matches FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{t}' AS table_name, (SELECT count(*) FROM {raw}) AS expected_rows,
            (SELECT count(*) FROM {t}) AS actual_rows"""
            for t, raw in _LOADED_FROM.items()
        )
        + ")",
        *TABLES,
    ),
    "published_portfolio": with_tables(
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _CSV), *_CSV
    ),
    "encode_categoricals": with_tables(
        f"{_ENCODED} FROM everyone "
        + " ".join(f"LEFT JOIN {_code(c)} t{i} ON t{i}.v = {c}" for i, c in enumerate(CATEGORICAL)),
        APP,
        "application_test",
        extra=_TRAIN | {"everyone": _EVERYONE},
    ),
    "impute_median": with_tables("SELECT * FROM filled", APP, extra=_TRAIN | _IMPUTED),
    "impute_mode": with_tables(
        "SELECT SK_ID_CURR, " + ", ".join(f"coalesce({c}, {_mode(c)}) AS {c}" for c in CATEGORICAL) + f" FROM {APP}",
        APP,
        extra=_TRAIN,
    ),
    "standardize": with_tables(
        "SELECT SK_ID_CURR, "
        + ", ".join(f"round(({c} - a_{c}) / s_{c}, 6) AS {c}" for c in NUMERIC)
        + f""" FROM filled, (SELECT {_SCALE} FROM filled
        WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM folded WHERE fold <> 1))""",
        APP,
        extra=_TRAIN | _IMPUTED,
    ),
    "one_hot_top20": with_tables(
        " UNION ALL ".join(
            [
                _slots("NAME_EDUCATION_TYPE", "NAME_EDUCATION_TYPE"),
                _slots("CODE_GENDER", "CODE_GENDER"),
                _slots("SEGMENT", "concat_ws('/', NAME_EDUCATION_TYPE, CAST(CNT_CHILDREN AS VARCHAR), CODE_GENDER)"),
            ]
        ),
        APP,
    ),
    "local_contributions": with_tables(
        "SELECT SK_ID_CURR, feature, value, round(contribution, 6) AS contribution FROM pushes", APP, extra=_PUSHES
    ),
    "top_n_per_row": with_tables(
        """SELECT SK_ID_CURR, place AS rank, feature, value, round(contribution, 6) AS contribution FROM placed
        WHERE place <= 3""",
        APP,
        extra=_PUSHES,
    ),
    "top_factors": with_tables(
        f"""SELECT SK_ID_CURR, place AS rank, feature, {_LABEL} AS label, round(value, 2) AS value,
        round(contribution, 4) AS contribution,
        CASE WHEN contribution > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction
        FROM placed WHERE place <= 6""",
        APP,
        extra=_PUSHES,
    ),
    "global_importance": with_tables(
        f"""SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs_contribution, {_LABEL} AS label FROM pushes
        GROUP BY feature""",
        APP,
        extra=_PUSHES,
    ),
    "rule_table": with_tables(
        """SELECT CAST(leaf AS DOUBLE) AS leaf, conditions, n_applicants, population_share, observed_default_rate,
        lift_over_base_rate, mean_predicted_score,
        'IF ' || CASE conditions WHEN '' THEN 'always' ELSE conditions END || ' THEN '
        || printf('%.1f%%', population_share * 100e0) || ' of applicants (' || format('{:,}', n_applicants)
        || '), observed default rate ' || printf('%.1f%%', observed_default_rate * 100e0)
        || printf(' (%.1fx base rate)', lift_over_base_rate) AS sentence FROM rules""",
        APP,
        extra={"ruled": _RULED, "rules": _RULES},
    ),
    "rule_fidelity": with_tables(
        f"""SELECT 'r2_vs_score' AS metric,
          1e0 - {mean("((p - s) * (p - s))", 9)} / {mean("((p - m) * (p - m))", 9)} AS value
        FROM crude, (SELECT {mean("p", 9)} AS m FROM crude)
        UNION ALL SELECT 'surrogate_roc_auc', roc_auc FROM ({_AUC.replace("{scored}", "(SELECT y, s AS p FROM crude)")})
        UNION ALL SELECT 'model_roc_auc', roc_auc FROM ({_AUC.replace("{scored}", "crude")})""",
        APP,
        extra={"scored": _SCORED, "crude": "SELECT *, floor(p * 4) / 4e0 + 0.125e0 AS s FROM scored"},
    ),
}
