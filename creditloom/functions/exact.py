"""Order-independent sums of doubles.

A plain ``sum(double)`` depends on the order in which partial sums meet, so a retried task or another
partitioning changes the last digits. Here each addend is cut, without any rounding, into five whole numbers of
28 bits that stand for multiples of fixed powers of two, and whole numbers add up the same way in every order.
Together they cover magnitudes from 2**-68 to 2**71; what lies below is lost, which is less than 1e-20 per
addend. Larger magnitudes, infinities and NaN are added as plain doubles, with the results that IEEE arithmetic
gives. A group may hold 3e10 rows before a lane could overflow, and an overflow is an error, never a wrong sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LANES = tuple(2.0**e for e in (44, 16, -12, -40, -68))
_LIMIT = 2.0**71

#: decimals that sums and means of amounts keep, and those of ratios and probabilities
PLACES = 6
MEAN_PLACES = 7
FINE_PLACES = 9


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def unrounded_sum(value: Column | str) -> Column:
    """Reproducible ``sum(value)``, the nearest double but for the last step; NULL when nothing was added."""
    number = _column(value).cast("double")
    usable = F.abs(number) < F.lit(_LIMIT)  # NaN is larger than every number here
    rest = F.when(usable, number)
    lanes = []
    for unit in _LANES:
        count = (rest / F.lit(unit)).cast("long")
        lanes.append(F.sum(count).cast("double") * F.lit(unit))
        rest = rest - count * F.lit(unit)
    odd = F.sum(F.when(~usable, number))
    regular = lanes[0] + (lanes[1] + (lanes[2] + (lanes[3] + lanes[4])))
    return F.when(odd.isNull(), regular).when(regular.isNull(), odd).otherwise(odd + regular)


def exact_sum(value: Column | str, places: int = PLACES) -> Column:
    """Reproducible ``sum(value)``, rounded once at the end."""
    return F.round(unrounded_sum(value), places)


def exact_mean(value: Column | str, places: int = MEAN_PLACES) -> Column:
    """Reproducible ``avg(value)``, rounded once at the end; NULL addends are skipped."""
    return F.round(unrounded_sum(value) / F.nullif(F.count(_column(value)), F.lit(0)), places)
