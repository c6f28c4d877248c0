"""Hard negatives by exact inner products, scored with Four-Russians tables.

The dimensions of an anchor are cut into groups of eight. For each group a table holds the sums of all 256 subsets of
its components. A candidate's whole-number components are written in two's complement and packed by bit plane: one byte
for a group and plane says which of the eight components have that bit. Looked up in the anchor's table, the byte gives
the plane's share of the inner product; shift and add over the planes (the sign's plane counts negative) gives the full
exact score.

Every anchor meets every candidate, in blocks: candidates are dealt into slices of bounded size by a hash of their ids,
and the anchors stream through each slice, ``ANCHOR_BLOCK`` at a time. A task holds the packed planes of one slice and
the tables of one block, whatever the number of rows. A first pass keeps the best rows of an anchor's own label, a
second one the best rows of other labels within the bands that those set; only the few best of a slice leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.sources.intermediate import materialise

# Candidates whose bit planes a task holds at a time, and anchors whose tables it holds.
SLICE = 8192
ANCHOR_BLOCK = 64


def subset_tables(anchors: np.ndarray) -> np.ndarray:
    """For each group of eight dimensions and each subset of it (a byte), the sum of every anchor's components."""
    count, dimensions = anchors.shape
    groups = -(-dimensions // 8)
    components = np.zeros((groups * 8, count), np.int64)
    components[:dimensions] = anchors.T
    components = components.reshape(groups, 8, count)
    tables = np.zeros((groups, 256, count), np.int64)
    for bit in range(8):
        half = 1 << bit
        tables[:, half : 2 * half] = tables[:, :half] + components[:, bit, None]
    return tables


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """Bytes by plane, group of eight dimensions and vector; the last plane holds the signs."""
    largest = int(np.maximum(vectors, ~vectors).max(initial=0))
    planes = largest.bit_length() + 1
    return np.stack(
        [np.packbits(((vectors >> p) & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(min(planes, 64))]
    )


def inner_products(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact scores, one row for each packed vector and one column for each anchor."""
    groups = min(len(tables), planes.shape[1])  # dimensions that one side lacks count as zero there
    reach = int(np.abs(tables).max(initial=0)) * max(groups, 1) << len(planes)
    tables = tables.astype(np.int32) if 0 <= reach < 1 << 31 else tables
    scores = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for p in reversed(range(len(planes))):
        scores <<= 1
        for g in range(groups):
            share = tables[g][planes[p, g]]
            if p == len(planes) - 1:
                scores -= share
            else:
                scores += share
    return scores.astype(np.int64)


def _best(scores: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The n places of highest score; places come in the order that breaks ties."""
    if len(places) > n:
        found = scores[places]
        places = places[found >= np.partition(found, len(found) - n)[len(found) - n]]
    return places[np.argsort(-scores[places], kind="stable")[:n]]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers; shorter ones end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out


class _Slice:
    """The candidates of one slice, by label and id."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.ids, self.labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.planes = bit_planes(_matrix(rows["q"].combine_chunks()))

    def positives(self, block: pa.RecordBatch, n: int) -> Iterator[tuple]:
        """(anchor, positive, score) for the n best other rows of each anchor's label in this slice."""
        ids, labels, vectors = block["vec_id"].to_numpy(), block["label"].to_numpy(), _matrix(block["q"])
        for label in np.unique(labels):
            start, end = np.searchsorted(self.labels, [label, label + 1])
            mine = np.flatnonzero(labels == label)
            scores = inner_products(subset_tables(vectors[mine]), self.planes[:, :, start:end])
            for column, anchor in enumerate(ids[mine]):
                for place in _best(scores[:, column], np.flatnonzero(self.ids[start:end] != anchor), n):
                    yield anchor, self.ids[start + place], scores[place, column]

    def negatives(self, block: pa.RecordBatch, n: int, low: int, high: int) -> Iterator[tuple]:
        """(anchor, positive, its score, negative, its score), the n best in this slice for each positive."""
        ids, labels = block["vec_id"].to_numpy(), block["label"].to_numpy()
        scores = inner_products(subset_tables(_matrix(block["q"])), self.planes)
        by_id = np.argsort(self.ids, kind="stable")
        for column, positives in enumerate(block["positives"].to_pylist()):
            own = scores[by_id, column]
            other = self.labels[by_id] != labels[column]
            hundredfold = own * 100
            for positive in positives:
                bound = positive["score"]
                places = np.flatnonzero(other & (hundredfold >= low * bound) & (hundredfold <= high * bound))
                for place in _best(own, places, n):
                    yield ids[column], positive["id"], bound, self.ids[by_id[place]], own[place]


def _streamed(candidates: DataFrame, anchors: DataFrame, slices: int, found: str, work) -> DataFrame:
    """``work(slice, block of anchors)`` for every slice of candidates and every block of all anchors."""
    extra = [c for c in anchors.columns if c not in ("vec_id", "label", "q")]
    every = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("anchor", F.lit(True))
    both = candidates.withColumn("anchor", F.lit(False)).unionByName(every, allowMissingColumns=True)
    laid_out = both.repartition("slice").sortWithinPartitions("slice", "anchor", "label", "vec_id")
    names = [part.split()[0] for part in found.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ready = None, [], None
        for batch in batches:
            start = 0
            keys = np.stack([batch["slice"].to_numpy(), batch["anchor"].to_numpy(zero_copy_only=False).astype(np.int32)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for end in [*cuts.tolist(), batch.num_rows]:
                part = batch.slice(start, end - start)
                start = end
                if not part.num_rows:
                    continue
                if part["slice"][0].as_py() != number:
                    number, held, ready = part["slice"][0].as_py(), [], None
                if not part["anchor"][0].as_py():
                    held.append(part.select(["vec_id", "label", "q"]))
                    continue
                if not held and ready is None:
                    continue  # no candidate fell into this slice
                if ready is None:
                    ready, held = _Slice(held), []
                for first in range(0, part.num_rows, ANCHOR_BLOCK):
                    block = part.slice(first, ANCHOR_BLOCK).select(["vec_id", "label", "q", *extra])
                    rows = list(work(ready, block))
                    if rows:
                        columns = [pa.array(np.array(c, np.int64)) for c in zip(*rows)]
                        yield pa.RecordBatch.from_arrays(columns, names)

    return laid_out.mapInArrow(search, found)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, all longs but the int rank.

    ``vectors`` has vec_id (long), label (long) and q (array<long>); ``is_anchor`` is a condition on vec_id. Scores are
    inner products; higher ones come first, ties by the smaller vec_id. An anchor's positives are its first
    ``n_positives`` other rows of the same label; a positive's negatives are the first ``n_negatives`` rows of other
    labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``. Fewer are returned where there
    are fewer.

    Rows with a null in vec_id, label, q or inside q take no part. A repeated vec_id stands for one row, the one with the
    smallest label and then vector. Shorter vectors count as ended by zeros; sums beyond 64 bits wrap as longs do. An
    empty table, or one without anchors, gives no rows. Other columns are not read.
    """
    known = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("q").cast("array<long>").alias("q")
    ).filter("vec_id is not null and label is not null and q is not null and forall(q, x -> x is not null)")
    slices = max(1, -(-known.count() // SLICE))
    dealt = known.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")).repartition("slice")
    one = dealt.groupBy("slice", "vec_id").agg(F.min(F.struct("label", "q")).alias("row"))
    candidates = materialise(one.select("slice", "vec_id", "row.label", "row.q"), "vectors")
    anchors = candidates.filter(is_anchor).drop("slice")

    near = _streamed(
        candidates, anchors, slices, "vec_id long, id long, score long", lambda part, block: part.positives(block, n_positives)
    )
    best = Window.partitionBy("vec_id").orderBy(F.desc("score"), "id")
    chosen = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n_positives)
    positives = chosen.groupBy("vec_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    with_bands = materialise(anchors.join(positives.hint("merge"), "vec_id"), "positives")

    far = _streamed(
        candidates,
        with_bands,
        slices,
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
        lambda part, block: part.negatives(block, n_negatives, low, high),
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and q: every component x of ``embedding`` as floor(scale * x), x as double.

    Rows with a null vector, or with a null or non-finite component, are left out.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    usable = F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.filter(usable).select("vec_id", "label", scaled.alias("q"))


def mining_sql(source: str) -> str:
    """DuckDB SQL for ``hard_negatives`` with its own parameters on ``source`` (vec_id, label, q), anchors every fiftieth id."""
    return f"""
    WITH v AS ({source}),
    scored AS (
      SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label AS other_label,
             CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    positives AS (
      SELECT anchor_id, anchor_label, other_id AS positive_id, score AS positive_score FROM scored
      WHERE anchor_label = other_label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, p.positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
           s.other_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.other_label <> p.anchor_label
     AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
    QUALIFY rank <= 3
    """
