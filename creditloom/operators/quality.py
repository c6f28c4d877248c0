"""Profiling and data-quality checks: each table is read once, all columns at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import exact_mean, is_not_employed, ratio
from creditloom.operators.application import LABEL
from creditloom.operators.quantiles import exact_quantiles

# Business categories and the column-name prefixes that select them. The first category that
# matches wins, in this order, so AMT_CREDIT_SUM is "financial" and never "credit_history".
CATEGORY_PREFIXES: dict[str, tuple[str, ...]] = {
    "identifier": ("SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV"),
    "target": ("TARGET",),
    "demographic": (
        "CODE_GENDER", "DAYS_BIRTH", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "NAME_FAMILY_STATUS",
        "NAME_EDUCATION_TYPE", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE",
    ),
    "financial": (
        "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "NAME_INCOME_TYPE",
        "NAME_CONTRACT_TYPE", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "OWN_CAR_AGE",
    ),
    "employment": ("DAYS_EMPLOYED", "DAYS_REGISTRATION", "DAYS_ID_PUBLISH"),
    "external_score": ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"),
    "credit_history": (
        "CREDIT_ACTIVE", "CREDIT_TYPE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE",
        "CREDIT_DAY_OVERDUE", "DAYS_CREDIT", "NAME_CONTRACT_STATUS", "CODE_REJECT_REASON",
    ),
    "repayment_behaviour": (
        "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT", "SK_DPD", "SK_DPD_DEF",
        "STATUS", "MONTHS_BALANCE",
    ),
    "document_flag": ("FLAG_DOCUMENT",),
    "housing_detail": (
        "APARTMENTS", "BASEMENTAREA", "YEARS_BEGINEXPLUATATION", "YEARS_BUILD", "COMMONAREA", "ELEVATORS",
        "ENTRANCES", "FLOORSMAX", "FLOORSMIN", "LANDAREA", "LIVINGAPARTMENTS", "LIVINGAREA",
        "NONLIVINGAPARTMENTS", "NONLIVINGAREA",
    ),
    "region": ("REGION_", "REG_REGION", "REG_CITY", "LIVE_REGION", "LIVE_CITY"),
    "contact_flag": (
        "FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE", "FLAG_PHONE", "FLAG_EMAIL",
    ),
}


def business_category(column_name: Column | str) -> Column:
    """Category of a column name held in a column."""
    name = F.upper(F.col(column_name) if isinstance(column_name, str) else column_name)
    branches = F
    for category, prefixes in CATEGORY_PREFIXES.items():
        matches = reduce(Column.__or__, [name.startswith(p) for p in prefixes])
        branches = branches.when(matches, category)
    return branches.otherwise("other")


def _columns_in(df: DataFrame, category: str) -> list[str]:
    """Names of a table's columns in one category, decided from the schema alone."""
    names = []
    for column in df.columns:
        for found, prefixes in CATEGORY_PREFIXES.items():
            if column.upper().startswith(prefixes):
                if found == category:
                    names.append(column)
                break
    return names


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """Missing and total counts of every column, from one aggregate over one scan."""
    counts = df.agg(F.count(F.lit(1)).alias("n_total"), *[F.count(c).alias(f"filled_{c}") for c in df.columns])
    per_column = [
        F.struct(F.lit(c).alias("column_name"), (F.col("n_total") - F.col(f"filled_{c}")).alias("n_missing"))
        for c in df.columns
    ]
    return (
        counts.select("n_total", F.inline(F.array(*per_column)))
        .withColumn("table_name", F.lit(table))
        .withColumn("category", business_category("column_name"))
        .select("table_name", "column_name", "category", "n_missing", "n_total")
    )


def missing_values(
    tables: Mapping[str, DataFrame],
    names: Sequence[str] = ("application_train", "bureau", "previous_application"),
) -> DataFrame:
    """Columns with missing values, worst first, over several tables."""
    profiles = reduce(DataFrame.unionByName, [column_profile(tables[n], n) for n in names])
    return (
        profiles.filter(F.col("n_missing") > 0)
        .withColumn("pct_missing", F.col("n_missing") / F.col("n_total"))
        .orderBy(F.desc("pct_missing"), "table_name", "column_name")
    )


def column_categories(df: DataFrame, table: str) -> DataFrame:
    """Columns and filled cells per business category."""
    profile = column_profile(df, table)
    return (
        profile.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("columns"),
            F.sum(F.col("n_total") - F.col("n_missing")).alias("filled_cells"),
        )
        .orderBy("category")
    )


def table_summary(tables: Mapping[str, DataFrame], descriptions: Mapping[str, str]) -> DataFrame:
    """Rows, columns and a rough size (eight bytes a cell) per table, largest first."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.lit(descriptions.get(name, "")).alias("description"),
            "row_count",
            F.lit(len(df.columns)).cast("long").alias("column_count"),
            (F.col("row_count") * len(df.columns) * 8 / F.lit(1e6)).alias("approx_size_mb"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted).orderBy(F.desc("row_count"), "table_name")


# --- quality checks ----------------------------------------------------------------------------------------
#
# Every check contributes aggregates to one shared pass and turns its own aggregates into findings
# (finding, metric, value, severity). A check whose columns are absent contributes nothing.

INFO, NOTABLE, ACTION = "info", "notable", "action_needed"


def _finding(metric: str, value: Column, severity: Column | str) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(
        F.lit(metric).alias("metric"), value.cast("double").alias("value"), severity.alias("severity")
    )


def _labelled(finding: str, rows: Sequence[Column]) -> Column:
    return F.transform(F.array(*rows), lambda r: F.struct(F.lit(finding).alias("finding"), r.alias("r")))


def _sentinel(df: DataFrame):
    facts = {"sentinel_rows": F.count_if(is_not_employed())}
    rows = [
        _finding("count", F.col("sentinel_rows"), ACTION),
        _finding("pct", F.col("sentinel_rows") / F.col("n_total"), ACTION),
    ]
    return facts, rows


def _unknown_category(df: DataFrame):
    facts = {"unknown_gender": F.count_if(F.col("CODE_GENDER") == "XNA")}
    severity = F.when(F.col("unknown_gender") > 0, NOTABLE).otherwise(INFO)
    rows = [
        _finding("count", F.col("unknown_gender"), severity),
        _finding("pct", F.col("unknown_gender") / F.col("n_total"), severity),
    ]
    return facts, rows


def _day_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("DAYS_") and c != "DAYS_EMPLOYED"]


def _days_sign(df: DataFrame):
    columns = _day_columns(df)
    facts = {f"positive_{c}": F.count_if(F.col(c) > 0) for c in columns}
    anything = reduce(Column.__or__, [F.col(name) > 0 for name in facts])
    severity = F.when(anything, NOTABLE).otherwise(INFO)
    rows = [_finding("columns_checked", F.lit(len(columns)), severity)]
    rows += [_finding(f"positive {c}", F.col(f"positive_{c}"), severity) for c in columns]
    return facts, rows


def _block_missing(df: DataFrame):
    columns = _columns_in(df, "housing_detail")
    facts = {f"filled_{c}": F.count(c) for c in columns}
    # A complete column has nothing missing to report.
    shares = [F.nullif(F.lit(1.0) - F.col(name) / F.col("n_total"), F.lit(0.0)) for name in facts]
    pair = shares if len(shares) > 1 else shares * 2
    rows = [
        _finding("columns", F.lit(len(columns)), NOTABLE),
        _finding("min_pct_missing", F.least(*pair), NOTABLE),
        _finding("max_pct_missing", F.greatest(*pair), NOTABLE),
    ]
    return facts, rows


def _class_imbalance(df: DataFrame):
    facts = {"label_rate": F.avg(LABEL)}
    rate = F.col("label_rate")
    rows = [
        _finding("default_rate", rate, ACTION),
        _finding("imbalance_ratio", ratio(F.lit(1.0) - rate, rate), ACTION),
    ]
    return facts, rows


def _income_facts(df: DataFrame):
    return {"max_income": F.max("AMT_INCOME_TOTAL"), "mean_income": exact_mean("AMT_INCOME_TOTAL")}, []


_CHECKS = {
    "days_employed_sentinel": (lambda df: "DAYS_EMPLOYED" in df.columns, _sentinel),
    "gender_xna": (lambda df: "CODE_GENDER" in df.columns, _unknown_category),
    "income_outlier": (lambda df: "AMT_INCOME_TOTAL" in df.columns, _income_facts),
    "days_columns_sign": (lambda df: bool(_day_columns(df)), _days_sign),
    "building_stats_missing": (lambda df: bool(_columns_in(df, "housing_detail")), _block_missing),
    "class_imbalance": (lambda df: LABEL in df.columns, _class_imbalance),
}


def quality_report(applications: DataFrame, checks: Sequence[str] = tuple(_CHECKS)) -> DataFrame:
    """Findings of the given checks as rows ``(finding, metric, value, severity)``.

    The aggregates of all checks share one scan; the exact income median adds the two scans of its selection.
    Nothing is reported for an empty table.
    """
    built = {name: _CHECKS[name][1](applications) for name in checks if _CHECKS[name][0](applications)}
    aggregates = {"n_total": F.count(F.lit(1))}
    for facts, _ in built.values():
        aggregates |= facts
    facts = applications.agg(*[c.alias(name) for name, c in aggregates.items()]).filter("n_total > 0")
    if "income_outlier" in built:
        median = exact_quantiles(applications, ["AMT_INCOME_TOTAL"], [0.5])
        # One row on the left, at most one on the right: none when no income is known.
        median = median.select("column_name", F.col("value").alias("median_income"))
        facts = facts.withColumn("column_name", F.lit("AMT_INCOME_TOTAL")).join(median, "column_name", "left")
        largest = F.coalesce("max_income", F.lit(0.0))
        typical = F.greatest(F.coalesce("median_income", F.lit(1.0)), F.lit(1.0))
        built["income_outlier"] = (
            {},
            [
                _finding("max", F.col("max_income"), NOTABLE),
                _finding("median", F.col("median_income"), NOTABLE),
                _finding("mean", F.col("mean_income"), NOTABLE),
                _finding("max_to_median_ratio", largest / typical, NOTABLE),
            ],
        )
    labelled = [_labelled(name, rows) for name, (_, rows) in built.items()]
    entries = facts.select(F.explode(F.flatten(F.array(*labelled))).alias("e"))
    return entries.select("e.finding", "e.r.metric", "e.r.value", "e.r.severity")
