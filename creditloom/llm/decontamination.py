"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as their words in lower case, one blank between two of them. An item may be matched with at
most ``percent`` of its characters in edits. It is split into pieces, one more than its error budget, so at least one piece
stands unchanged in every match. All pieces of a block of items are looked up in one pass over a text. A piece hit is
verified from the bottom up: the stretch of pieces is doubled, and each stretch of n pieces must occur near the hit with
fewer than n edits (the same pigeonhole argument holds for every half), which ends most chance hits after a few
characters. Distances come from Myers' bit-parallel algorithm; a Python integer holds a whole column of the matrix.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Items whose pieces are looked up in one pass; more items take more passes.
ITEMS_PER_BLOCK = 2000
_WORD = re.compile(r"\w+")


def normalised(text: str) -> str:
    return " ".join(map(str.lower, _WORD.findall(text)))


def nearest(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """The smallest edit distance at which ``pattern`` ends somewhere in ``text``, and that end; None above ``limit``."""
    m = len(pattern)
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        places[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = None
    for j, c in enumerate(text, 1):
        equal = places.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up <<= 1
        down <<= 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score <= limit and (best is None or score < best[0]):
            best = (score, j)
    return best


class Item:
    """One benchmark item: its text, its error budget and where its pieces begin."""

    def __init__(self, number: int, text: str, percent: int) -> None:
        self.number, self.text = number, text
        self.budget = len(text) * percent // 100
        n = self.budget + 1
        self.edges = [len(text) * i // n for i in range(n + 1)]

    def stretches(self, piece: int) -> Iterator[tuple[int, int]]:
        """The nodes above a piece in the tree of halves, from the smallest to the whole item."""
        low, high, path = 0, self.budget + 1, []
        while high - low > 1:
            path.append((low, high))
            middle = (low + high) // 2
            low, high = (low, middle) if piece < middle else (middle, high)
        return reversed(path)

    def match(self, text: str, piece: int, at: int) -> tuple[int, int, int] | None:
        """Start, end and distance of a match of the item around its piece found at ``at``."""
        for low, high in self.stretches(piece):
            limit = high - low - 1
            pattern = self.text[self.edges[low] : self.edges[high]]
            begin = max(0, at - (self.edges[piece] - self.edges[low]) - limit)
            end = at + self.edges[high] - self.edges[piece] + limit
            found = nearest(pattern, text[begin:end], limit)
            if found is None:
                return None
        if not self.budget:
            return at, at + len(self.text), 0
        end = begin + found[1]
        # The same search backwards from the end gives the start.
        back = nearest(self.text[::-1], text[max(0, end - len(self.text) - self.budget) : end][::-1], found[0])
        return end - back[1], end, found[0]


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], percent: int) -> None:
        places: dict[str, list[tuple[Item, int]]] = defaultdict(list)
        for number, text in items:
            if text:
                item = Item(number, text, percent)
                for i in range(item.budget + 1):
                    places[item.text[item.edges[i] : item.edges[i + 1]]].append((item, i))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in places.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """Item number, start, end and distance of every match; matches of one item do not overlap."""
        if not len(self.automaton):
            return
        done: dict[int, int] = {}
        for last, (length, owners) in self.automaton.iter(text):
            at = last + 1 - length
            for item, piece in owners:
                if at < done.get(item.number, 0):
                    continue
                found = item.match(text, piece, at)
                if found is not None and found[0] >= done.get(item.number, 0):
                    done[item.number] = found[1]
                    yield (item.number, *found)


def _spans(text: str, matches: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Matches with their places in the text as given instead of in its normalised form."""
    words = [m.span() for m in _WORD.finditer(text)]
    begins, at = [], 0
    for a, b in words:
        begins.append(at)
        at += len(text[a:b].lower()) + 1
    for number, start, end, distance in matches:
        yield number, words[bisect_right(begins, start) - 1][0], words[bisect_right(begins, end - 1) - 1][1], distance


def _blocks(items: DataFrame) -> Iterator[Broadcast]:
    """The items' ids and normalised texts, broadcast in blocks of about ITEMS_PER_BLOCK."""
    blocks = -(-items.count() // ITEMS_PER_BLOCK) or 1
    dealt = items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn(
        "block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    )
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).select("item_id", "text").collect()
        known = [(i, r.item_id, normalised(r.text or "")) for i, r in enumerate(rows)]
        yield items.sparkSession.sparkContext.broadcast(known)


def contaminations(documents: DataFrame, items: DataFrame, percent: int = 10) -> DataFrame:
    """One row per match: doc_id, item_id, start and end (code points of the text, whole words), distance.

    ``items`` has item_id and text. A null or wordless item matches nothing, as does a null or wordless text. Repeated
    rows are matched one by one; an empty table on either side gives no rows. Of matches of one item that overlap in a
    text, one is reported. Other columns are not read.
    """

    def of_block(known: Broadcast) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher([(i, text) for i, _, text in known.value], percent)
            ids = [item_id for _, item_id, _ in known.value]
            for batch in batches:
                out = []
                for doc, cell in zip(batch.column("doc_id"), batch.column("text")):
                    text = cell.as_py() or ""
                    matches = list(matcher.find(normalised(text)))
                    if matches:
                        out.extend((doc.as_py(), ids[n], *rest) for n, *rest in _spans(text, matches))
                if out:
                    types = [pa.int64()] * 4 + [pa.int32()]
                    names = ["doc_id", "item_id", "start", "end", "distance"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        schema = "doc_id long, item_id long, start long, end long, distance int"
        return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, schema)

    return reduce(DataFrame.unionByName, map(of_block, _blocks(items)))


def without_contaminated(documents: DataFrame, items: DataFrame, percent: int = 10) -> DataFrame:
    """The documents, with all their columns, whose texts match no item."""

    def of_block(rest: DataFrame, known: Broadcast) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher([(i, text) for i, _, text in known.value], percent)
            for batch in batches:
                clean = [next(matcher.find(normalised(t.as_py() or "")), None) is None for t in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return rest.mapInArrow(keep, rest.schema)

    return reduce(of_block, _blocks(items), documents)
