"""Statements for samples, splits, metrics, bands and scoring."""

from __future__ import annotations

from oracles.bindings import TABLES, with_tables
from oracles.features import mean
from oracles.segments import spread

APP = "application_train"
H = spread()

_RANKED = f"""SELECT SK_ID_CURR, TARGET, row_number() OVER (PARTITION BY TARGET ORDER BY {H}, SK_ID_CURR) AS rn,
  count(*) OVER (PARTITION BY TARGET) AS stratum_n, count(*) OVER () AS total_n FROM {APP}"""
_FOLDED = """SELECT SK_ID_CURR, TARGET, CAST(1 + CAST(rn > stratum_n // 5 AS INTEGER)
  + CAST(rn > 2 * stratum_n // 5 AS INTEGER) + CAST(rn > 3 * stratum_n // 5 AS INTEGER)
  + CAST(rn > 4 * stratum_n // 5 AS INTEGER) AS INTEGER) AS fold FROM ranked"""
_SAMPLE = """SELECT SK_ID_CURR, TARGET FROM ranked
  WHERE rn <= greatest(1, CAST(floor(400 * stratum_n / total_n + 0.5e0) AS BIGINT))"""
_LITE = {
    "application_train": "SELECT SK_ID_CURR FROM sample",
    "application_test": f"SELECT 1 FROM application_test WHERE {H} % 100 < 16",
    "bureau": "SELECT 1 FROM bureau WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM sample)",
    "bureau_balance": """SELECT 1 FROM bureau_balance WHERE SK_ID_BUREAU IN
      (SELECT SK_ID_BUREAU FROM bureau WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM sample))""",
    "previous_application": "SELECT 1 FROM previous_application WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM sample)",
    "installments_payments": "SELECT 1 FROM installments_payments WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM sample)",
    "credit_card_balance": "SELECT 1 FROM credit_card_balance WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM sample)",
    "pos_cash_balance": "SELECT 1 FROM pos_cash_balance WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM sample)",
}

_SAMPLING = {
    "stratified_rank": with_tables(_RANKED, APP),
    "stratified_sample": with_tables(_SAMPLE, APP, extra={"ranked": _RANKED}),
    "hash_percent_sample": with_tables(
        f"SELECT SK_ID_CURR, AMT_CREDIT FROM application_test WHERE {H} % 100 < 16", "application_test"
    ),
    "hash_order_sample": with_tables(
        f"""SELECT SK_ID_CURR, AMT_INCOME_TOTAL, AMT_CREDIT, CODE_GENDER, NAME_EDUCATION_TYPE, TARGET FROM {APP}
        ORDER BY {H}, SK_ID_CURR LIMIT 20""",
        APP,
    ),
    "train_holdout_split": with_tables(
        """SELECT SK_ID_CURR, TARGET, CASE WHEN rn <= floor(stratum_n * 0.1e0 + 0.5e0) THEN 'test'
        WHEN rn <= floor(stratum_n * 0.2e0 + 0.5e0) THEN 'calibrate'
        WHEN rn <= floor(stratum_n * 0.28e0 + 0.5e0) THEN 'early_stop' ELSE 'fit' END AS split FROM ranked""",
        APP,
        extra={"ranked": _RANKED},
    ),
    "kfold_assign": with_tables(_FOLDED, APP, extra={"ranked": _RANKED}),
    "undersample_majority": with_tables(
        f"""SELECT SK_ID_CURR, TARGET FROM
        (SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY {H}, SK_ID_CURR) AS place FROM folded WHERE fold <> 1)
        WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM folded WHERE fold <> 1 GROUP BY TARGET))""",
        APP,
        extra={"ranked": _RANKED, "folded": _FOLDED},
    ),
    "class_weights": with_tables(
        f"""SELECT SK_ID_CURR, TARGET, CASE WHEN TARGET = 1 THEN
        (SELECT CAST(count(*) FILTER (TARGET = 0) AS DOUBLE) / count(*) FILTER (TARGET = 1) FROM {APP})
        ELSE 1e0 END AS weight FROM {APP}""",
        APP,
    ),
    "lite_cascade": with_tables(
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, count(*) AS row_count FROM ({sql})" for name, sql in _LITE.items()
        ),
        *TABLES,
        extra={"ranked": _RANKED, "sample": _SAMPLE},
    ),
}

# --- metrics: every statement runs on both score variants ---

_SCORED = f"SELECT SK_ID_CURR AS id, TARGET AS y, 1e0 - EXT_SOURCE_2 AS p FROM {APP} WHERE EXT_SOURCE_2 IS NOT NULL"
_TIED = "SELECT id, y, floor(p * 100) / 100e0 AS p FROM scored"


def _on(table: str, metric: str) -> str:
    return metric.replace("{scored}", table)


def _both(metric: str) -> str:
    body = (
        f"SELECT *, 'distinct' AS scores FROM ({_on('scored', metric)}) UNION ALL BY NAME "
        f"SELECT *, 'tied' AS scores FROM ({_on('tied', metric)})"
    )
    return with_tables(body, APP, extra={"scored": _SCORED, "tied": _TIED})


_LADDER = """(SELECT score, n, pos, sum(n) OVER w AS cn, sum(pos) OVER w AS cpos, sum(n) OVER () AS nt,
  sum(pos) OVER () AS pt, row_number() OVER w AS i, lead(n) OVER w AS n2, lead(pos) OVER w AS pos2, count(*) OVER () AS k
  FROM (SELECT p AS score, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS pos FROM {scored} GROUP BY p)
  WINDOW w AS (ORDER BY score DESC))"""
_TPR = "(CAST(cpos AS DOUBLE) / CAST(pt AS DOUBLE))"
_FPR = "(CAST(cn - cpos AS DOUBLE) / CAST(nt - pt AS DOUBLE))"

_AUC = f"""SELECT CAST(sum(pos * (2 * ((nt - pt) - (cn - cpos)) + (n - pos))) AS DOUBLE)
  / (CAST(max(pt) AS DOUBLE) * CAST(max(nt - pt) AS DOUBLE) * 2) AS roc_auc FROM {_LADDER}"""
_AP = f"""SELECT round(sum(CAST(pos AS DOUBLE) / CAST(pt AS DOUBLE) * (CAST(cpos AS DOUBLE) / CAST(cn AS DOUBLE))), 9)
  AS average_precision FROM {_LADDER}"""
_KS = f"SELECT max(abs({_TPR} - {_FPR})) AS ks_statistic FROM {_LADDER}"
_BRIER = f"SELECT {mean('((p - y) * (p - y))', 9)} AS brier_score FROM {{scored}}"
_BASE = "SELECT avg(y) AS base_rate FROM {scored}"
_CURVE = f"""SELECT CAST(point AS BIGINT) AS point, fpr, tpr FROM (
  SELECT point, fpr, tpr, max(point) OVER () AS last FROM (
    SELECT row_number() OVER (ORDER BY i) AS point, {_FPR} AS fpr, {_TPR} AS tpr FROM {_LADDER}
    WHERE k <= 2 OR i = 1 OR i = k OR n <> n2 OR pos <> pos2
    UNION ALL SELECT 0, 0e0, 0e0))
  WHERE last < 200 OR point IN (SELECT j * last // 199 FROM range(200) r(j))"""
_POSITION = "(SELECT id, y, p, row_number() OVER (ORDER BY p DESC, id) - 1 AS pos0, count(*) OVER () AS nt FROM {scored})"
_LIFT = f"""SELECT CAST(b AS BIGINT) AS decile, CAST(n AS BIGINT) AS applicants,
    CAST(n AS DOUBLE) / nt AS population_share, CAST(d AS DOUBLE) / greatest(n, 1) AS default_rate,
    (CAST(d AS DOUBLE) / greatest(n, 1)) / (CAST(dt AS DOUBLE) / CAST(nt AS DOUBLE)) AS lift,
    CAST(dc AS BIGINT) AS cumulative_defaults, CAST(dc AS DOUBLE) / greatest(dt, 1) AS cumulative_capture
  FROM (SELECT b, n, d, sum(n) OVER () AS nt, sum(d) OVER () AS dt, sum(d) OVER (ORDER BY b) AS dc FROM (
    SELECT b, count(id) AS n, coalesce(sum(y), 0) AS d
    FROM range(1, 11) r(b) LEFT JOIN {_POSITION} ON pos0 >= nt * (b - 1) // 10 AND pos0 < nt * b // 10 GROUP BY b))"""
_GAINS = f"SELECT decile, cumulative_defaults, cumulative_capture FROM ({_LIFT})"
_EDGES = ", ".join(f"quantile_cont(p, {i / 10}) AS e{i}" for i in range(1, 10))
_ABOVE = " + ".join(f"CAST(e{i} < p AS INTEGER)" for i in range(1, 10))
_CALIBRATION = f"""SELECT CAST(1 + {_ABOVE} AS INTEGER) AS bin, count(*) AS applicants,
  {mean('p', 9)} AS mean_predicted, avg(y) AS fraction_positive
  FROM {{scored}}, (SELECT {_EDGES} FROM {{scored}}) GROUP BY 1"""


def _confusion(threshold: str) -> str:
    return f"""SELECT count(*) FILTER (p < {threshold} AND y = 0) AS true_negative,
      count(*) FILTER (p >= {threshold} AND y = 0) AS false_positive,
      count(*) FILTER (p < {threshold} AND y = 1) AS false_negative,
      count(*) FILTER (p >= {threshold} AND y = 1) AS true_positive FROM {{scored}}"""


_PRECISION_RECALL = """SELECT
  CASE WHEN true_positive + false_positive > 0 THEN CAST(true_positive AS DOUBLE) / (true_positive + false_positive)
    ELSE 0e0 END AS precision,
  CASE WHEN true_positive + false_negative > 0 THEN CAST(true_positive AS DOUBLE) / (true_positive + false_negative)
    ELSE 0e0 END AS recall FROM """
_COST = """SELECT threshold, cost, fn, fp FROM (
  SELECT t AS threshold, count(*) FILTER (p < t AND y = 1) AS fn, count(*) FILTER (p >= t AND y = 0) AS fp,
    count(*) FILTER (p < t AND y = 1) * 10e0 + count(*) FILTER (p >= t AND y = 0) * 1e0 AS cost
  FROM (SELECT DISTINCT round_even(p * 1e4, 0) / 1e4 AS t FROM {scored}), {scored} GROUP BY t)
  ORDER BY cost, threshold LIMIT 1"""
_BANDS = f"""SELECT band, CASE band WHEN 'Low' THEN 0e0 ELSE round(min(p), 4) END AS score_threshold,
    count(*) AS applicants, CAST(count(*) AS DOUBLE) / max(nt) AS population_share, avg(y) AS default_rate,
    avg(y) / max(base) AS lift, max(base) AS base_rate
  FROM (SELECT y, p, nt, avg(y) OVER () AS base, CASE WHEN pos0 < greatest(nt // 10, 1) THEN 'High'
    WHEN pos0 < nt // 2 THEN 'Medium' ELSE 'Low' END AS band FROM {_POSITION}) GROUP BY band"""


def _long(metric: str, section: str, position: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, CAST({position} AS BIGINT) AS position, '{c}' AS metric, "
        f"CAST({c} AS DOUBLE) AS value FROM {metric}"
        for c in columns
    )


_REPORT = {
    "scored": _SCORED,
    "best": _on("scored", _COST),
    "auc": _on("scored", _AUC),
    "ap": _on("scored", _AP),
    "ks": _on("scored", _KS),
    "brier": _on("scored", _BRIER),
    "base": _on("scored", _BASE),
    "confusion": _on("scored", _confusion("(SELECT threshold FROM best)")),
    "pr": _PRECISION_RECALL + "confusion",
    "lift": _on("scored", _LIFT),
    "calibration": _on("scored", _CALIBRATION),
}
_REPORT_ROWS = " UNION ALL ".join(
    [
        _long("auc", "summary", "0", ["roc_auc"]),
        _long("ap", "summary", "0", ["average_precision"]),
        _long("ks", "summary", "0", ["ks_statistic"]),
        _long("brier", "summary", "0", ["brier_score"]),
        _long("base", "summary", "0", ["base_rate"]),
        _long("best", "summary", "0", ["threshold"]),
        _long(
            "confusion", "summary", "0", ["true_negative", "false_positive", "false_negative", "true_positive"]
        ),
        _long("pr", "summary", "0", ["precision", "recall"]),
        _long(
            "lift",
            "lift",
            "decile",
            ["applicants", "population_share", "default_rate", "lift", "cumulative_defaults", "cumulative_capture"],
        ),
        _long("calibration", "calibration", "bin", ["applicants", "mean_predicted", "fraction_positive"]),
    ]
)

_TEST_SCORED = _SCORED.replace(f"FROM {APP}", "FROM application_test").replace("TARGET AS y, ", "")
_BANDED = """SELECT s.*, CASE WHEN p >= h THEN 'High' WHEN p >= m THEN 'Medium' ELSE 'Low' END AS band,
  CASE WHEN p >= h THEN h WHEN p >= m THEN m ELSE 0e0 END AS band_threshold, base AS base_rate,
  round(p / base, 2) AS lift_over_base_rate
  FROM {source} s, (SELECT max(score_threshold) FILTER (band = 'High') AS h,
  max(score_threshold) FILTER (band = 'Medium') AS m, max(base_rate) AS base FROM bands)"""

STATEMENTS: dict[str, str] = _SAMPLING | {
    "roc_auc": _both(_AUC),
    "average_precision": _both(_AP),
    "ks_statistic": _both(_KS),
    "brier_score": _both(_BRIER),
    "base_rate": _both(_BASE),
    "roc_curve": _both(_CURVE),
    "lift_table": _both(_LIFT),
    "cumulative_gains": _both(_GAINS),
    "calibration_curve": _both(_CALIBRATION),
    "confusion_matrix": _both(_confusion("0.6e0")),
    "precision_recall_at_threshold": _both(f"{_PRECISION_RECALL} ({_confusion('0.6e0')})"),
    "cost_threshold": _both(_COST),
    "risk_bands": _both(_BANDS),
    "evaluation_report": with_tables(_REPORT_ROWS, APP, extra=_REPORT),
    "score_portfolio": with_tables(
        _BANDED.replace("{source}", f"({_TEST_SCORED})"),
        APP,
        "application_test",
        extra={"scored": _SCORED, "bands": _on("scored", _BANDS)},
    ),
    "score_with_outcome": with_tables(
        "SELECT b.*, s.y AS actual_target FROM ("
        + _BANDED.replace("{source}", f"(SELECT id, p FROM scored UNION ALL {_TEST_SCORED})")
        + ") b LEFT JOIN scored s USING (id)",
        APP,
        "application_test",
        extra={"scored": _SCORED, "bands": _on("scored", _BANDS)},
    ),
}
