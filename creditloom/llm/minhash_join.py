"""Near duplicates by MinHash signatures and an inverted join of their coordinates.

A document's set of word shingles gets a signature: for each of ``coordinates`` hash functions the smallest value in the
set. Two sets agree in a coordinate with a probability equal to their similarity, so pairs that reach the similarity
agree in at least ``least_matches`` coordinates but for one pair in a million. Finding all pairs that agree in so many is
an overlap join, and the candidates that it keeps are confirmed on the full sets.

* **Inverted lists.** Every (coordinate, value) pair is a token, and documents are posted under their tokens. Documents
  with equal sets are one posting, under the smallest id.
* **Prefix.** All documents put their tokens into one order. Two that share ``t`` of ``k`` tokens share one at least of
  the first ``k - t + 1``, so only these are posted. The order runs from rare to frequent, by counts in a table of fixed
  size, so the long lists of a common passage are not merged at all. Any order is exact; this one keeps lists short.
* **Skipping.** In each list, everyone is counted against one document first, the one with the most frequent tokens, which copies
  have in common with the text that they are copies of; what that links needs no further counting. Only lists that still hold several components are merged in full, and there only pairs of different
  components, in blocks of bounded size, whose sizes can reach the similarity.

So no pair that agrees often enough is lost, and no list is written out as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.components import components
from creditloom.llm.meetings import confirmed
from creditloom.llm.parity_join import folded, most_difference, sketch, sketch_words
from creditloom.llm.text import mix, pieces, shingle_sets
from creditloom.sources.intermediate import materialise

COORDINATES = 48
# A pair of exactly the asked similarity has too few equal coordinates with at most this probability.
MISSED = 1e-6
# Members of one list that are counted against one another in one block.
BLOCK = 1024
# Bits of the table of token counts, 2 MB whatever the input.
COUNT_BITS = 18
# Rows of whole blocks that are worked on at a time.
_HELD = 8 * BLOCK


@cache
def least_matches(coordinates: int, percent: int, missed: float = MISSED) -> int:
    """The largest number of equal coordinates that pairs of this similarity reach but for a share of ``missed``."""
    p, below, t = percent / 100, 0.0, 0
    while t < coordinates:
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > missed:
            break
        t += 1
    return max(t, 1)


@cache
def _functions(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.arange(coordinates, dtype=np.uint64)
    return mix(numbers + np.uint64(0x5BD1E995)), mix(numbers + np.uint64(0xC2B2AE35)) | np.uint64(1)


def signatures(hashes: np.ndarray, begins: np.ndarray, coordinates: int) -> np.ndarray:
    """The signature of every row's set, 32 bits a coordinate; that of an empty set means nothing."""
    out = np.zeros((len(begins) - 1, coordinates), np.uint32)
    filled = np.flatnonzero(np.diff(begins))
    if len(filled):
        flips, factors = _functions(coordinates)
        for j in range(coordinates):
            values = (hashes ^ flips[j]) * factors[j]
            out[filled, j] = np.minimum.reduceat(values, begins[:-1][filled]) >> np.uint64(32)
    return out


def _tokens(drawn: np.ndarray) -> np.ndarray:
    """64-bit tokens of (coordinate, value) pairs."""
    number = np.arange(drawn.shape[1], dtype=np.uint64) << np.uint64(32)
    return mix(drawn.astype(np.uint64) | number)


def _drawn(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _signed(texts: DataFrame, width: int, coordinates: int) -> DataFrame:
    """doc_id, the set's size, a 128-bit digest of the set, its signature and a parity sketch, for every row.

    The sketch is for the full-set check: it bounds the sets' difference, with two to four bits for a shingle.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                hashes, begins = shingle_sets(part, width)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)]) for h in (hashes, mix(hashes))]
                digests = [pa.array((s[begins[1:]] - s[begins[:-1]]).view(np.int64)) for s in sums]
                drawn = [row.tobytes() for row in signatures(hashes, begins, coordinates)]
                folds = [sketch(hashes[a:b], 2 * sketch_words(int(b - a))).tobytes() for a, b in zip(begins[:-1], begins[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(begins), pa.int64()), *digests, pa.array(drawn, pa.binary()), pa.array(folds, pa.binary())],
                    ["doc_id", "n_shingles", "high", "low", "signature", "sketch"],
                )

    return texts.mapInArrow(sign, "doc_id long, n_shingles long, high long, low long, signature binary, sketch binary")


def _token_counts(classes: DataFrame) -> np.ndarray:
    """How often the tokens of each cell occur; cells are the upper bits of a token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = _tokens(_drawn(batch.column("signature"))) >> np.uint64(64 - COUNT_BITS)
                found, times = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(times)], ["cell", "times"])

    cells = classes.select("signature").mapInArrow(count, "cell int, times long").groupBy("cell").agg(F.sum("times").alias("times"))
    out = np.zeros(1 << COUNT_BITS, np.int64)
    found = cells.toArrow()  # one row a cell at most
    out[found["cell"].to_numpy()] = found["times"].to_numpy()
    return out


def _postings(classes: DataFrame, counts: np.ndarray, prefix: int) -> DataFrame:
    """token, doc_id and weight for the first ``prefix`` tokens of every document, from rare to frequent.

    The weight adds the counts of all its tokens up: the text that others are copies of has more frequent ones than they.
    """
    shared = classes.sparkSession.sparkContext.broadcast(counts)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens = _tokens(_drawn(batch.column("signature")))
                times = shared.value[tokens >> np.uint64(64 - COUNT_BITS)]
                first = np.lexsort((tokens, times), axis=1)[:, :prefix]
                posted = np.take_along_axis(tokens, first, axis=1).ravel().view(np.int64)
                docs, weights = (np.repeat(c, prefix) for c in (batch.column("doc_id").to_numpy(), times.sum(axis=1)))
                yield pa.RecordBatch.from_arrays([pa.array(posted), pa.array(docs), pa.array(weights)], ["token", "doc_id", "weight"])

    return classes.select("doc_id", "signature").mapInArrow(post, "token long, doc_id long, weight long")


def _size_reaches(one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(one, other) >= percent * np.maximum(one, other)


class _Sketches:
    """The parity sketches of rows, at their own and at half their width."""

    def __init__(self, column: pa.Array, sizes: np.ndarray) -> None:
        self.sizes = sizes
        drawn = [np.frombuffer(s, np.uint64) for s in column.to_pylist()]
        self.words = np.array([len(d) for d in drawn], np.int64)
        self.place = np.zeros((2, len(drawn)), np.int64)
        self.by_words: dict[int, np.ndarray] = {}
        for words in np.unique(np.concatenate([self.words, self.words // 2])).tolist():
            rows = [np.flatnonzero(self.words == words), np.flatnonzero(self.words == 2 * words)]
            self.place[0, rows[0]], self.place[1, rows[1]] = np.arange(len(rows[0])), len(rows[0]) + np.arange(len(rows[1]))
            self.by_words[words] = np.array([drawn[i] for i in rows[0]] + [folded(drawn[i], words) for i in rows[1]], np.uint64).reshape(-1, words)

    def allow(self, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sketches of rows of near sizes leave it possible that their sets reach the similarity."""
        good = np.ones(len(one), bool)
        shared = np.minimum(self.words[one], self.words[other])
        for words in np.unique(shared).tolist():
            some = np.flatnonzero(shared == words)
            a, b = (self.by_words[words][self.place[(self.words[r[some]] > words).astype(int), r[some]]] for r in (one, other))
            distance = np.bitwise_count(a ^ b).sum(axis=1)
            good[some] = distance <= most_difference(self.sizes[one[some]] + self.sizes[other[some]], percent)
        return good


def _counted(pairs: DataFrame, classes: DataFrame, percent: int, least: int) -> DataFrame:
    """Those of the pairs (a, b) that agree in ``least`` coordinates and whose sizes and sketches allow the similarity."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_drawn(batch.column("signature_a")) == _drawn(batch.column("signature_b"))).sum(axis=1)
                sizes = [batch.column(f"n_{side}").to_numpy() for side in "ab"]
                good = np.flatnonzero((equal >= least) & _size_reaches(*sizes, percent))
                left = batch.take(pa.array(good))
                drawn = pa.concat_arrays([left.column(f"sketch_{side}") for side in "ab"])
                sketches = _Sketches(drawn, np.concatenate([n[good] for n in sizes]))
                rows = np.arange(len(good))
                yield left.select(["a", "b"]).filter(pa.array(sketches.allow(rows, rows + len(good), percent), pa.bool_()))

    joined = pairs
    for side in "ab":
        own = classes.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{n}_{side}") for c, n in _CARRIED.items()])
        joined = joined.join(own.hint("merge"), side)
    return joined.select("a", "b", *[f"{n}_{side}" for n in _CARRIED.values() for side in "ab"]).mapInArrow(count, "a long, b long")


_CARRIED = {"n_shingles": "n", "signature": "signature", "sketch": "sketch"}


def _agreeing(rows: pa.Table, percent: int, least: int) -> pa.RecordBatch:
    """Pairs (a, b) of different components that agree often enough, in whole blocks in the order of their keys."""
    token, lo, hi, part, doc, component, size = (
        rows[c].to_numpy() for c in ("token", "lo", "hi", "part", "doc_id", "component", "n_shingles")
    )
    drawn, sketches = _drawn(rows["signature"].combine_chunks()), _Sketches(rows["sketch"], size)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    block = np.cumsum(new)
    found: list[np.ndarray] = []
    for step in range(1, int(np.bincount(block).max(initial=0))):
        one = np.flatnonzero(block[step:] == block[:-step])
        other = one + step
        # Of a block of two parts only the mixed pairs are its own.
        asked = (component[one] != component[other]) & ((lo[one] == hi[one]) | (part[one] != part[other]))
        asked &= _size_reaches(size[one], size[other], percent)
        one, other = one[asked], other[asked]
        good = (drawn[one] == drawn[other]).sum(axis=1) >= least
        one, other = one[good], other[good]
        good = sketches.allow(one, other, percent)
        found.append(np.sort(np.stack([doc[one[good]], doc[other[good]]], axis=1), axis=1))
    pairs = np.unique(np.concatenate(found or [np.zeros((0, 2), np.int64)]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _across_components(lists: DataFrame, found: DataFrame, classes: DataFrame, percent: int, least: int) -> DataFrame:
    """Pairs (a, b) of different components that stand in one list and agree in ``least`` coordinates."""
    labelled = lists.join(found.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select(
        "token", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    mixed = labelled.groupBy("token").agg(
        F.min("component").alias("first"), F.max("component").alias("last"), F.count(F.lit(1)).alias("members")
    )
    # Two members have been counted against one another already.
    mixed = mixed.filter("first < last and members > 2").select("token", F.ceil(F.col("members") / BLOCK).alias("blocks"))
    dealt = (
        labelled.join(mixed.hint("merge"), "token")
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .join(classes.hint("merge"), "doc_id")
        .select(
            "token", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
            "part", "doc_id", "component", "n_shingles", "signature", "sketch",
        )
    )
    dealt = dealt.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < _HELD:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([rows[c].to_numpy() for c in ("token", "lo", "hi")])
            last = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0)).max(initial=-1)) + 1
            if last:
                yield _agreeing(rows.slice(0, last), percent, least)
            held = rows.slice(last).to_batches()
        if held:
            yield _agreeing(pa.Table.from_batches(held), percent, least)

    return dealt.mapInArrow(merge, "a long, b long").distinct()


def minhash_groups(documents: DataFrame, width: int = 5, percent: int = 85, coordinates: int = COORDINATES) -> DataFrame:
    """One row per row: doc_id, n_shingles (the set's size), component_id and kept (whether the two ids are equal).

    A set holds the distinct runs of ``width`` words of the lower-cased (A-Z) text; fewer words make one run of them
    all. Two documents are linked when ``100 * intersection >= percent * union``; component_id is the smallest doc_id
    that links reach. Null texts, and texts without words, have empty sets and reach themselves alone. Ids are taken to
    be unique; a repeated row gives the same row again. Rows with a null id are linked with nothing and are kept. An
    empty table gives no rows. Columns besides doc_id and text are not read.
    """
    least = least_matches(coordinates, percent)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = materialise(_signed(texts, width, coordinates), "signatures")
    equal = ["n_shingles", "high", "low"]
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    by_set = filled.groupBy(*equal).agg(F.min("doc_id").alias("class_id"), F.any_value(F.struct("signature", "sketch")).alias("drawn"))
    by_set = materialise(by_set.select(*equal, "class_id", "drawn.*"), "sets")
    # An id that repeats with different texts can lead several sets; one of them speaks for it.
    classes = by_set.groupBy(F.col("class_id").alias("doc_id")).agg(F.min(F.struct("n_shingles", "signature", "sketch")).alias("s"))
    classes = materialise(classes.select("doc_id", "s.*"), "classes")
    class_of = signed.drop("signature", "sketch").join(by_set.select(*equal, "class_id").hint("merge"), equal, "left")

    postings = materialise(_postings(classes, _token_counts(classes), coordinates - least + 1), "postings")
    heads = postings.groupBy("token").agg(
        F.max(F.struct("weight", "doc_id")).alias("head"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    )
    heads = heads.filter("first < last").select("token", F.col("head.doc_id").alias("leader"))
    lists = materialise(postings.drop("weight").join(heads.hint("merge"), "token"), "lists")
    met = lists.filter("leader <> doc_id")
    meetings = met.select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct()
    pairs = materialise(_counted(meetings, classes, percent, least), "pairs")
    links = confirmed(pairs, texts, width, percent)
    found = components(links)
    across = _across_components(lists, found, classes, percent, least)
    across = materialise(across.join(pairs.hint("merge"), ["a", "b"], "left_anti"), "across")
    if not across.isEmpty():
        more = confirmed(across, texts, width, percent)
        found = components(links.unionByName(more))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id"))
    return class_of.join(found.withColumnRenamed("node", "class_id").hint("merge"), "class_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def groups_sql(width: int = 5, percent: int = 85) -> str:
    """DuckDB SQL for ``minhash_groups`` on the table ``documents``."""
    return f"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    runs AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS run
      FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
    shared AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id),
    links AS (
      SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * n_both >= {percent} * (x.n + y.n - n_both)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached(doc_id, node) AS (
      SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.node),
    component AS (SELECT doc_id, min(node) AS component_id FROM reached GROUP BY doc_id)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d JOIN component c ON c.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
    """
