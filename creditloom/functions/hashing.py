"""A seeded arithmetic hash of a client id.

It uses nothing but integer arithmetic, so any SQL engine can reproduce it and a draw made today can be
audited elsewhere. Every intermediate product stays below 2**63, which ANSI mode requires.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 1 << 32

_FOLD = 1 << 31
_FIRST_MULTIPLIER = 2654435761
_SECOND_MULTIPLIER = 2246822519


def spread_hash(key: Column | str, seed: int = 0) -> Column:
    """Map an integer key to ``[0, 2**32)`` so that neighbouring keys land far apart."""
    key = F.col(key) if isinstance(key, str) else key
    folded = F.pmod(key.cast("long") + F.lit(seed), F.lit(_FOLD))
    first = folded * F.lit(_FIRST_MULTIPLIER) % F.lit(HASH_SPACE)
    mixed = first.bitwiseXOR(F.shiftright(first, 15)).bitwiseAND(F.lit(_FOLD - 1))
    return mixed * F.lit(_SECOND_MULTIPLIER) % F.lit(HASH_SPACE)
