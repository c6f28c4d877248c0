"""Views of Arrow text columns as byte buffers, and hashes of byte ranges of such buffers.

A null text counts as an empty one everywhere in this package.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and the offset at which each row starts (one more at the end)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``most_bytes`` of text each, unless one row alone is larger."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PrefixHash:
    """Polynomial prefix hashes modulo 2**64 of one buffer: the hash of any range costs two look-ups."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        if len(PrefixHash._powers) <= len(data):
            n = max(len(data) + 1, 1 << 21)
            PrefixHash._powers = _powers_of(_BASE, n)
            PrefixHash._inverses = _powers_of(_INVERSE, n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * PrefixHash._powers[: len(data)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of every byte range, equal for equal bytes wherever they stand."""
        raw = (self.sums[ends] - self.sums[starts]) * PrefixHash._inverses[starts]
        return mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the number of words before each row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    # A word never crosses from one row into the next.
    joined = cuts[inside[cuts] & inside[cuts + 1]]
    begins[joined] = True
    ends[joined] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts of a batch, and where each row's begin (one more at the end)."""
    data, offsets = text_bytes(batch.column("text"))
    data = lower_ascii(data)
    starts, ends, before = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(batch.num_rows + 1, np.int64)
    words = PrefixHash(data).ranges(starts, ends)
    n_words = np.diff(before)
    # Runs are formed everywhere and dropped where they would reach into the next row.
    last = np.repeat(before[1:], n_words)
    place = np.arange(len(words))
    length = np.minimum(width, np.repeat(n_words, n_words))
    runs = np.zeros(len(words), np.uint64)
    for j in range(width):
        taken = j < length
        follower = words[np.minimum(place + j, len(words) - 1)]
        runs = np.where(taken, mix(runs * np.uint64(0x9E3779B97F4A7C15) + follower + np.uint64(j + 1)), runs)
    whole = place + length <= last
    rows = np.repeat(np.arange(batch.num_rows), n_words)[whole]
    runs = runs[whole]
    order = np.lexsort((runs, rows))
    runs, rows = runs[order], rows[order]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (rows[1:] != rows[:-1])
    return runs[fresh], np.searchsorted(rows[fresh], np.arange(batch.num_rows + 1))
