"""Row-level features of one application."""

from __future__ import annotations

from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import clean_tenure, is_not_employed, ratio, years

ID = "SK_ID_CURR"
LABEL = "TARGET"
EXTERNAL_SCORES = ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")

# feature -> (numerator, denominator)
_AFFORDABILITY = {
    "CREDIT_INCOME_RATIO": ("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    "ANNUITY_INCOME_RATIO": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "CREDIT_TERM": ("AMT_ANNUITY", "AMT_CREDIT"),
    "CREDIT_GOODS_RATIO": ("AMT_CREDIT", "AMT_GOODS_PRICE"),
    "INCOME_PER_FAMILY_MEMBER": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
}


def _tenure_and_age() -> dict[str, Column]:
    return {
        "AGE_YEARS": years("DAYS_BIRTH"),
        "YEARS_EMPLOYED": years(clean_tenure()),
        "EMPLOYED_LIFE_FRACTION": ratio(clean_tenure(), "DAYS_BIRTH"),
        "FLAG_NOT_EMPLOYED": is_not_employed().cast("int"),
        "YEARS_REGISTERED": years("DAYS_REGISTRATION"),
        "YEARS_SINCE_ID_PUBLISH": years("DAYS_ID_PUBLISH"),
    }


def _external_scores() -> dict[str, Column]:
    """Combinations of the bureau scores.

    A missing score counts as 1 for the minimum and as 0 for the maximum and the product, so a client with no
    score at all has minimum 1, maximum 0 and product 0, while the mean is NULL.
    """
    as_zero = [F.coalesce(c, F.lit(0.0)) for c in EXTERNAL_SCORES]
    as_one = [F.coalesce(c, F.lit(1.0)) for c in EXTERNAL_SCORES]
    missing = reduce(add, [F.isnull(c).cast("int") for c in EXTERNAL_SCORES])
    return {
        "EXT_SOURCE_MEAN": ratio(reduce(add, as_zero), F.lit(len(EXTERNAL_SCORES)) - missing),
        "EXT_SOURCE_MIN": F.least(*as_one),
        "EXT_SOURCE_MAX": F.greatest(*as_zero),
        "EXT_SOURCE_PRODUCT": reduce(mul, as_zero),
        "EXT_SOURCE_MISSING_COUNT": missing,
    }


def derived_columns() -> dict[str, Column]:
    """The 17 application features, by name."""
    affordability = {name: ratio(top, bottom) for name, (top, bottom) in _AFFORDABILITY.items()}
    per_child = {"INCOME_PER_CHILD": ratio("AMT_INCOME_TOTAL", F.col("CNT_CHILDREN") + 1)}
    return affordability | per_child | _tenure_and_age() | _external_scores()


def with_derived_features(applications: DataFrame) -> DataFrame:
    return applications.withColumns(derived_columns())


def derived_features(applications: DataFrame) -> DataFrame:
    """The id and the derived features only."""
    return applications.select(ID, *[c.alias(name) for name, c in derived_columns().items()])
