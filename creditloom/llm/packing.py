"""Packing of token ids into training windows by multiway differencing.

A document's ids end with the id 1. Whole windows are taken off the front of long documents and the rest is cut into
items of at most ``item_tokens`` ids: the smaller the items, the nearer to equal the windows. Tasks collect items until
they fill ``group_windows`` windows, less a small slack, and part them into that many windows by Karmarkar-Karp
differencing: every item starts as a partial partition whose windows but one are empty, and the two partial partitions
with the largest imbalances are merged again and again, the fullest windows of one with the emptiest of the other, until
one partition is left. Its windows are near equal. If one of them exceeds the capacity, the group is parted anew into one
window more. Items of a document that meet again in a window, one after the other, become one piece.

The end of a task's input, or all of a small one, has no full group; it is differenced in the same way into as many
windows as it fills. What is left over, less than a window and the slack, is laid out in windows whose lengths are the powers of
two that add up to it, so they need no padding.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from creditloom.llm.token_counts import byte_alphabet

END_ID = 1
# A worker forgets its known words beyond this many; the ids do not depend on it.
KNOWN_WORDS = 500_000
# Unicode white space: no token of the vocabulary reaches over it.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xde\xdf-\xf6\xf8-\xff]+)([.,:;!?]*)")
_FIELDS = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids", pa.binary()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
]

Piece = tuple[int, int, bytes, int]  # document, start, little-endian ids, the document's number of ids


class WordIds(dict):
    """Little-endian 32-bit ids by word, filled as words appear.

    A word of Latin letters that marks other than apostrophes may follow is what nearly every word of the four languages
    is. The tokenizer lower-cases its letters, makes one unit of them and one of the marks; so the letters go straight to
    its merge model. Every other word goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters: dict[str, bytes] = {}
        self.printable = {byte: char for char, byte in byte_alphabet().items()}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            packed = self._encode(word)
        else:
            packed = self._of_letters(plain[1].lower())
            if plain[2]:
                packed += self[plain[2]]
        self[word] = packed
        return packed

    def _encode(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _of_letters(self, letters: str) -> bytes:
        packed = self.letters.get(letters)
        if packed is None:
            if len(self.letters) >= KNOWN_WORDS:
                self.letters.clear()
            shown = letters if letters.isascii() else "".join(map(self.printable.__getitem__, letters.encode()))
            packed = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            self.letters[letters] = packed
        return packed

    def of(self, text: str) -> bytes:
        """The ids of a text: those of its words in turn, since the tokenizer never joins two of them."""
        # Python takes four separators for white space that the tokenizer does not.
        odd = any(mark in text for mark in "\x1c\x1d\x1e\x1f")
        return b"".join(map(self.__getitem__, _SPACE.split(text) if odd else text.split()))


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Item numbers by window, near equal in total size (Karmarkar-Karp differencing).

    Only windows that hold something are written down for a partial partition; the others are empty.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        merged = _merge(one, two, windows)
        lowest = merged[-1][0] if len(merged) == windows else 0
        if lowest:  # only differences between windows matter
            merged = [(load - lowest, items) for load, items in merged]
        heapq.heappush(heap, (-merged[0][0], serial, merged))
        serial += 1
    parts = [items for _, items in heap[0][2]] if heap else []
    return parts + [[] for _ in range(windows - len(parts))]


def _merge(one: list, two: list, windows: int) -> list:
    """The fullest windows of one partial partition with the emptiest of the other."""
    free = windows - len(one)
    merged = list(one)
    # Windows are sorted from the fullest; the first ones of ``two`` meet the empty ones at the end of ``one``.
    for place, (load, items) in enumerate(two):
        if place < free:
            merged.append((load, items))
        else:
            other = windows - 1 - place
            merged[other] = (merged[other][0] + load, merged[other][1] + items)
    merged.sort(key=lambda w: -w[0])
    return merged


def _cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``at`` ids of a run of pieces, and the others."""
    head, tail = [], []
    for doc, start, ids, total in pieces:
        n = min(max(at, 0), len(ids) // 4)
        at -= n
        if n:
            head.append((doc, start, ids[: 4 * n], total))
        if 4 * n < len(ids):
            tail.append((doc, start + n, ids[4 * n :], total))
    return head, tail


def pack_group(pieces: list[Piece], windows: int, capacity: int) -> Iterator[list[Piece]]:
    """The windows of one group, none above the capacity; their number rises until that holds."""
    sizes = [len(p[2]) // 4 for p in pieces]
    while True:
        parts = difference(sizes, windows)
        if all(sum(sizes[i] for i in part) <= capacity for part in parts):
            break
        windows += 1
    for part in parts:
        if part:
            yield _joined(pieces[i] for i in sorted(part))


def _joined(pieces: Iterable[Piece]) -> list[Piece]:
    """Neighbouring pieces of one document made one."""
    out: list[Piece] = []
    for doc, start, ids, total in pieces:
        if out and out[-1][0] == doc and out[-1][1] + len(out[-1][2]) // 4 == start:
            ids = out[-1][2] + ids
            start = out.pop()[1]
        out.append((doc, start, ids, total))
    return out


def pack_rest(pieces: list[Piece], capacity: int) -> Iterator[list[Piece]]:
    """Full windows, then windows whose lengths are powers of two."""
    left = sum(len(p[2]) // 4 for p in pieces)
    while left:
        length = capacity if left >= capacity else 1 << (left.bit_length() - 1)
        window, pieces = _cut(pieces, length)
        left -= length
        yield _joined(window)


def packed(
    documents: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    item_tokens: int = 256,
    group_windows: int = 64,
    slack: int = 768,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id and offset.

    Each id of each document lies in exactly one piece. A null or empty text has the end id alone; repeated rows are
    documents of their own; no documents give no rows. Columns besides doc_id and text are not read. ``slack`` ids of
    a full group, and their share of a smaller one, are left for the imbalance that differencing leaves. A sequence number holds the task's partition, so a
    task that runs again gives the same numbers to the rows that it packs.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        serial = TaskContext.get().partitionId() << 33
        waiting: list[Piece] = []
        held = 0
        full = group_windows * capacity - slack

        def rows(windows: Iterator[list[Piece]]) -> Iterator[tuple]:
            nonlocal serial
            for window in windows:
                offset = 0
                for doc, start, ids, total in window:
                    yield doc, start, len(ids) // 4, ids, total, serial, offset
                    offset += len(ids) // 4
                serial += 1

        out: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = (known.of(text.as_py()) if text.is_valid else b"") + end
                total = len(ids) // 4
                whole = (total - 1) // capacity * capacity
                for start in range(0, whole, capacity):
                    out.extend(rows(iter([[(doc, start, ids[4 * start : 4 * (start + capacity)], total)]])))
                for start in range(whole, total, item_tokens):
                    waiting.append((doc, start, ids[4 * start : 4 * (start + item_tokens)], total))
                held += total - whole
                while held >= full:
                    group, waiting = _cut(waiting, full)
                    held -= full
                    out.extend(rows(pack_group(group, group_windows, capacity)))
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
        windows = held // capacity
        if windows:
            group, waiting = _cut(waiting, windows * capacity - -(-slack * windows // group_windows))
            # Fewer windows are balanced by smaller items, as many as a full group has.
            size = max(1, item_tokens * windows // group_windows)
            items = [(doc, start + i, ids[4 * i : 4 * (i + size)], total) for doc, start, ids, total in group for i in range(0, len(ids) // 4, size)]
            out.extend(rows(pack_group(items, windows, capacity)))
        out.extend(rows(pack_rest(waiting, capacity)))
        if out:
            yield _batch(out)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(pack, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [n for n, _ in _FIELDS])
