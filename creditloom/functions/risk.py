"""Small expressions shared by feature, segment and quality operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tenure sentinel of the source data and the length of a year in days.
NOT_EMPLOYED_SENTINEL = 365243
DAYS_PER_YEAR = 365.25


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that yields NULL for a zero denominator (ANSI division would fail the job)."""
    return _column(numerator) / F.nullif(_column(denominator), F.lit(0))


def is_not_employed(tenure: Column | str = "DAYS_EMPLOYED") -> Column:
    return _column(tenure) == F.lit(NOT_EMPLOYED_SENTINEL)


def clean_tenure(tenure: Column | str = "DAYS_EMPLOYED") -> Column:
    """Day offset with the sentinel turned into NULL."""
    return F.nullif(_column(tenure), F.lit(NOT_EMPLOYED_SENTINEL))


def years(day_offset: Column | str) -> Column:
    """Years before the application date; offsets are negative."""
    return -_column(day_offset) / F.lit(DAYS_PER_YEAR)
