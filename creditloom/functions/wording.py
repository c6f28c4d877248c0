"""Display helpers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def humanise(name: Column | str) -> Column:
    """``AMT_INCOME_TOTAL`` -> ``Amt income total``."""
    words = F.trim(F.replace(_column(name), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substr(words, F.lit(2))))


def fixed(value: Column, digits: int) -> Column:
    """``value`` with ``digits`` decimals, rounded as the double that it is, exact ties to even.

    ``format_string`` alone rounds the shortest decimal that names the double, half up: 58.15 lies below its name.
    """
    # The product and its exact error; the scale has few bits.
    scale = F.lit(10.0**digits)
    product = value * scale
    upper = value * F.lit(134217729.0)
    upper = upper - (upper - value)
    error = (upper * scale - product) + (value - upper) * scale
    nearest = F.rint(product)
    between = F.abs(product - nearest) == F.lit(0.5)
    whole = F.when(between & (error > 0), product + F.lit(0.5)).when(between & (error < 0), product - F.lit(0.5)).otherwise(nearest)
    return F.format_string(f"%.{digits}f", whole / scale)


def percent(share: Column | str, digits: int = 1) -> Column:
    """``0.0813`` -> ``8.1%``; NULL -> ``n/a``."""
    share = _column(share)
    text = F.concat(fixed(share * F.lit(100.0), digits), F.lit("%"))
    return F.when(share.isNotNull(), text).otherwise("n/a")


def currency(amount: Column | str) -> Column:
    """``1234567.8`` -> ``1,234,568``; NULL -> ``n/a``."""
    return F.coalesce(F.format_number(_column(amount), 0), F.lit("n/a"))


def display_number(value: Column | str) -> Column:
    """Two decimals for reading; NaN and infinities have nothing to show."""
    number = _column(value).cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(finite, F.round(number, 2))
