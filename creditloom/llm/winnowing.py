"""Winnowed document fingerprints, with DataFrame functions only.

The units are words between ASCII white space. Every run of ``k`` words has a hash; of every ``window`` neighbouring
hashes the smallest is kept, the rightmost of equal ones, with its position. So whatever shares ``k + window - 1``
neighbouring words shares a kept hash. A text with fewer than ``window`` runs keeps its smallest hash; one with fewer
than ``k`` words has a single run, of all its words; one without words keeps nothing.

A kept value is one 64-bit number: 40 bits of hash above 24 bits that count down with the position. The smallest number
of a window is the smallest hash with the rightmost tie, and it names its position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions beyond 2**24 words (about 100 MB of text) start again from 0.
POSITION_BITS = 24
_POSITION_MASK = (1 << POSITION_BITS) - 1
_SMALLEST = -(1 << 63)
_FANOUT = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often a lambda inside refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kept_values(text: Column, k: int, window: int) -> Column:
    """The kept values of a text, in the order of their positions."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.transform(F.filter(F.split(spaced, " "), lambda w: w != ""), lambda w: F.xxhash64(w))
    return _let(words, lambda hashed: _let(_runs(hashed, k), lambda runs: F.array_distinct(_smallest(runs, window))))


def _runs(hashed: Column, k: int) -> Column:
    n = F.size(hashed)
    run = lambda i: _valued(F.xxhash64(*[F.get(hashed, i + j) for j in range(k)]), i)
    return (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n < k, F.array(_valued(F.xxhash64(hashed), F.lit(0))))
        .otherwise(F.transform(F.sequence(F.lit(0), n - k), run))
    )


def _valued(hashed: Column, position: Column) -> Column:
    place = F.lit(_POSITION_MASK) - position.bitwiseAND(F.lit(_POSITION_MASK))
    return F.shiftleft(hashed, POSITION_BITS).bitwiseOR(place.cast("bigint"))


def _smallest(runs: Column, window: int) -> Column:
    n = F.size(runs)
    return (
        F.when(n == 0, runs)
        .when(n <= window, F.array(F.array_min(runs)))
        .otherwise(F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.array_min(F.slice(runs, i, window))))
    )


def fingerprint_text(kept: Column) -> Column:
    """Kept values as text: hexadecimal numbers between blanks."""
    return F.concat_ws(" ", F.transform(kept, lambda v: F.hex(v)))


def hashes_of(kept: Column) -> Column:
    """The distinct hashes of kept values, without their positions."""
    return F.array_distinct(F.transform(kept, lambda v: F.shiftright(v, POSITION_BITS)))


def likeness(one: Column, other: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty sets are alike."""
    shared = F.size(F.array_intersect(one, other))
    either = F.size(one) + F.size(other) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def fingerprints(documents: DataFrame, k: int = 5, window: int = 8) -> DataFrame:
    """doc_id and kept (array of numbers) of every row; a null text is an empty one."""
    return documents.select("doc_id", kept_values(F.coalesce("text", F.lit("")), k, window).alias("kept"))


def _bounds(keys: DataFrame, rows_each: int, most: int) -> list[int]:
    """Keys that end ranges of about ``rows_each`` rows, at most ``most``, the largest key among them."""
    n = keys.count()
    ranges = max(1, min(most, n // rows_each))
    found = keys.agg(
        F.percentile_approx("_key", F.lit([i / ranges for i in range(1, ranges + 1)]), F.lit(20 * ranges + 1000)),
        F.max("_key"),
    ).first()
    return sorted({*found[0], found[1]}) if n else []


def _range_of(bounds: list[int], key: Column) -> Column:
    """The number of bounds below ``key``: a search tree of arrays with 64 entries at each step."""
    levels = [bounds]
    while len(levels[-1]) > _FANOUT:
        levels.append(levels[-1][_FANOUT - 1 :: _FANOUT])
    place = F.lit(0)
    for level in reversed(levels):
        part = F.slice(F.lit(level), place * _FANOUT + 1, _FANOUT) if len(level) > _FANOUT else F.lit(level)
        place = place * _FANOUT + F.size(F.filter(part, lambda bound: bound < key))
    return place


def edited_fingerprints(
    documents: DataFrame, k: int = 5, window: int = 8, range_rows: int = 2000, most_ranges: int = 1 << 16
) -> DataFrame:
    """Each document's kept values beside those of an edited text and of the next document.

    The next document follows in descending doc_id (a null id is the smallest; rows with equal ids follow in the order
    of their texts' digests); the first follows the last. The edited text has its last ``floor(n_chars / 3)`` code
    points replaced by the first as many (or all) of the next document. A null text is an empty one. One row per row:
    doc_id, n_chars, edited_sha256, kept, edited_kept, next_kept. Columns besides doc_id and text are not read.

    Documents are put into ranges of ids; the last document of a range also stands at the end of the range below, where
    it is the next of that range's last one. So texts are shuffled once and no task sees more than one range.
    """
    keyed = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_SMALLEST)).alias("_key"),
        F.coalesce("text", F.lit("")).alias("_text"),
    )
    bounds = _bounds(keyed.select("_key"), range_rows, most_ranges) or [0]
    own = keyed.withColumn("_range", _range_of(bounds, F.col("_key")).cast("int"))
    following = F.when(F.col("_range") == len(bounds) - 1, F.lit(0)).otherwise(F.col("_range") + 1)
    is_bound = F.get(F.lit(bounds), F.col("_range")) == F.col("_key")
    guest = lambda number, is_guest: F.struct(number.alias("_range"), F.lit(is_guest).alias("_guest"))
    places = F.when(is_bound, F.array(guest(F.col("_range"), False), guest(following, True))).otherwise(
        F.array(guest(F.col("_range"), False))
    )
    placed = own.select("doc_id", "_key", "_text", F.inline(places)).repartition("_range")
    order = Window.partitionBy("_range").orderBy("_guest", F.desc("_key"), "_digest")
    met = (
        placed.withColumn("_digest", F.xxhash64("_text"))
        .withColumn("kept", kept_values(F.col("_text"), k, window))
        .select(
            "doc_id", "_guest", "_text", "kept", F.lead("_text").over(order).alias("_next"),
            F.lead("kept").over(order).alias("next_kept"),
        )
        .filter(~F.col("_guest"))
    )
    n = F.char_length("_text")
    taken = F.expr("char_length(_text) DIV 3").cast("int")
    edited = met.withColumn(
        "_edited", F.concat(F.substring("_text", F.lit(1), n - taken), F.substring("_next", F.lit(1), taken))
    )
    return edited.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        "kept",
        kept_values(F.col("_edited"), k, window).alias("edited_kept"),
        "next_kept",
    )
