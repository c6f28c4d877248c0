from creditloom.functions.exact import FINE_PLACES, exact_mean, exact_sum
from creditloom.functions.hashing import HASH_SPACE, spread_hash
from creditloom.functions.risk import clean_tenure, is_not_employed, ratio, years
from creditloom.functions.wording import currency, display_number, fixed, humanise, percent

__all__ = [
    "FINE_PLACES",
    "HASH_SPACE",
    "clean_tenure",
    "currency",
    "display_number",
    "exact_mean",
    "exact_sum",
    "fixed",
    "humanise",
    "is_not_employed",
    "percent",
    "ratio",
    "spread_hash",
    "years",
]
