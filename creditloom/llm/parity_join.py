"""Similarity join of word shingle sets with parity sketches.

A document's set holds the hashes of its distinct runs of ``width`` words. A sketch throws every hash into one of
``parts`` words of 64 bits and flips one bit there, so equal numbers cancel: the Hamming distance of two sketches is at
most the size of the sets' symmetric difference. Two sets that reach the similarity differ in at most

    limit = floor((1 - s) / (1 + s) * (size of one + size of the other))

elements. With ``limit + 2`` parts, two parts at least hold no differing element, so they are equal in both (pigeonhole).
A part that no element of a set falls into says little, so a set with one empty part does not send it: another equal part
remains. A set with more of them sends all its parts.

Sizes are cut into bands whose ends grow by 1/s, so partners lie in one band or in neighbours. The pair of bands
(i - 1, i) is one group with its own number of parts; each document sends its parts to two groups. Equal part values meet
in one bucket. Whoever meets in a bucket is compared with the bucket's smallest document: first sketches, then the
sets themselves. That joins most of what belongs together, however many copies there are, with as many comparisons
as members. Where a bucket still holds several components, its members of different components are compared by their
sketches in blocks of bounded size, and the pairs that pass by their sets. So no link between components is lost, and
no bucket is written out as all its pairs.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.components import components
from creditloom.llm.meetings import confirmed
from creditloom.llm.text import mix, pieces, shingle_sets
from creditloom.sources.intermediate import materialise, release

# Members of one bucket that are compared by sketches in one block.
BLOCK = 1024
# The fewest words of 64 bits in the sketch that every set carries along.
SHORT_SKETCH = 8
_BAND_MASK = 0xFF
_LARGEST_SET = 1 << 40


@cache
def _band_starts(similarity_percent: int) -> tuple[int, ...]:
    """The smallest set size of every band; each similarity has its own, whatever the process was asked before."""
    starts = [1]
    while starts[-1] <= _LARGEST_SET:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 100 // similarity_percent)))
    return tuple(starts)


def band_of(size: int, similarity_percent: int) -> int:
    """The band of a set size; the sizes of partners lie in one band or in two neighbours."""
    return bisect_right(_band_starts(similarity_percent), size) - 1


def most_difference(total_size: int, similarity_percent: int) -> int:
    """The largest symmetric difference at which sets of this total size still reach the similarity."""
    return total_size * (100 - similarity_percent) // (100 + similarity_percent)


def parts_of(band: int, similarity_percent: int) -> int:
    """The number of sketch parts of the group of bands (band - 1, band)."""
    return most_difference(2 * (_band_starts(similarity_percent)[band + 1] - 1), similarity_percent) + 2


def sketch_words(size: int) -> int:
    """The words of the sketch that a set carries along: a power of two, with one to two bits for a shingle.

    Any width gives a bound; this one tells sets apart that share a third. A wide sketch folds into a narrower one.
    """
    return max(SHORT_SKETCH, 1 << max(0, size.bit_length() - 6))


def folded(drawn: np.ndarray, words: int) -> np.ndarray:
    """The narrower sketch that a carried one contains; both widths are powers of two."""
    return np.bitwise_xor.reduce(drawn.reshape(-1, words), axis=0)


def sketch(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The parity sketch of one set: ``parts`` words of 64 bits."""
    out = np.zeros(parts, np.uint64)
    part = ((hashes >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
    np.bitwise_xor.at(out, part, np.uint64(1) << (hashes & np.uint64(63)))
    return out


def bucket_keys(hashes: np.ndarray, band: int, similarity_percent: int) -> np.ndarray:
    """The buckets that a set's sketch parts fall into in one group.

    Here a part is as wide as the hashes have values; instead of its bits, the XOR of codes of its odd bits stands for it.
    """
    parts = parts_of(band, similarity_percent)
    part = ((hashes >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
    codes = np.zeros(parts, np.uint64)
    np.bitwise_xor.at(codes, part, mix(hashes))
    number = np.arange(parts, dtype=np.uint64) + (np.uint64(band) << np.uint64(40))
    spread = mix(codes ^ mix(number))
    filled = np.bincount(part, minlength=parts) > 0
    if parts - filled.sum() == 1:
        spread = spread[filled]
    return (spread & ~np.uint64(_BAND_MASK)) | np.uint64(band)  # 8 bits tell 200 bands, sets of 10**9 shingles


def _digests(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, the set's size and a 128-bit digest of the set, for every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                hashes, begins = shingle_sets(part, width)
                sums = [np.zeros(len(hashes) + 1, np.uint64) for _ in range(2)]
                np.cumsum(hashes, out=sums[0][1:])
                np.cumsum(mix(hashes), out=sums[1][1:])
                columns = [pa.array((s[begins[1:]] - s[begins[:-1]]).view(np.int64)) for s in sums]
                drawn = [sketch(hashes[a:b], sketch_words(int(b - a))).tobytes() for a, b in zip(begins[:-1], begins[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(begins), pa.int64()), *columns, pa.array(drawn, pa.binary())],
                    ["doc_id", "n_shingles", "high", "low", "sketch"],
                )

    return documents.mapInArrow(digest, "doc_id long, n_shingles long, high long, low long, sketch binary")


def _buckets(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """bucket and doc_id of every sketch part; of equal sets in one batch only the smallest document sends any."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for part in pieces(batch.sort_by("doc_id")):
                hashes, begins = shingle_sets(part, width)
                keys, docs = [], []
                for doc, start, end in zip(part.column("doc_id").to_pylist(), begins[:-1], begins[1:]):
                    own = hashes[start:end]
                    equal = (len(own), int(own.sum()), int(mix(own).sum()))
                    if doc is None or start == end or equal in seen:
                        continue
                    seen.add(equal)
                    band = band_of(len(own), percent)
                    found = np.concatenate([bucket_keys(own, b, percent) for b in (band, band + 1)])
                    keys.append(found)
                    docs.append(np.full(len(found), doc, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(docs))],
                        ["bucket", "doc_id"],
                    )

    return documents.mapInArrow(send, "bucket long, doc_id long")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and carried sketches do not rule out; a bound, so no link is lost.

    ``sketches`` has doc_id, n_shingles and sketch.
    """

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = [batch.column(f"n_{side}").to_numpy() for side in "ab"]
            limit = (size[0] + size[1]) * (100 - percent) // (100 + percent)
            good = np.abs(size[0] - size[1]) <= limit
            for i in np.flatnonzero(good):
                drawn = [np.frombuffer(batch.column(f"sketch_{side}")[i].as_buffer(), np.uint64) for side in "ab"]
                words = min(map(len, drawn))
                good[i] = np.bitwise_count(folded(drawn[0], words) ^ folded(drawn[1], words)).sum() <= limit[i]
            yield batch.select(["a", "b"]).filter(pa.array(good))

    joined = pairs
    for side in "ab":
        own = sketches.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        joined = joined.join(own.hint("merge"), side)
    return joined.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(sift, "a long, b long")


def _pairs_of_block(members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of different components in one block whose sketches do not rule the similarity out.

    A block holds one part of a bucket (lo = hi), or two parts (lo < hi) of which only mixed pairs are its own.
    """
    alone = members.lo.iloc[0] == members.hi.iloc[0]
    rows, columns = (members, members) if alone else (members[members.part == members.lo], members[members.part == members.hi])
    found = [np.zeros((0, 2), np.int64)]
    if len(rows) and len(columns):
        words = members["sketch"].str.len().min() // 8
        narrow = lambda drawn: folded(np.frombuffer(drawn, np.uint64), words)
        columns = columns.sort_values("size", kind="stable")
        rows = columns if alone else rows
        sketches = np.stack([narrow(s) for s in columns["sketch"]])
        size, component, doc = (columns[c].to_numpy() for c in ("size", "component", "doc_id"))
        for place, one in enumerate(zip(rows["doc_id"], rows["component"], rows["size"], rows["sketch"])):
            limit = (size + one[2]) * (100 - percent) // (100 + percent)
            near = np.flatnonzero(np.abs(size - one[2]) <= limit)
            if not len(near):
                continue
            # Sizes rise, so those near enough stand together; inside one part each pair is met once.
            first, last = max(near[0], place + 1 if alone else 0), near[-1] + 1
            distance = np.bitwise_count(sketches[first:last] ^ narrow(one[3])).sum(axis=1)
            met = doc[first:last][(distance <= limit[first:last]) & (component[first:last] != one[1])]
            found.append(np.column_stack([np.minimum(met, one[0]), np.maximum(met, one[0])]))
    return pd.DataFrame(np.concatenate(found), columns=["a", "b"]).drop_duplicates()


def _pairs_across_components(crowded: DataFrame, found: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and that their sketches do not rule out.

    ``crowded`` holds the distinct (bucket, doc_id), ``found`` the components so far, ``sketches`` every set's size and
    carried sketch.
    """
    labelled = crowded.join(found.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )
    mixed = labelled.groupBy("bucket").agg(
        F.min("component").alias("first"), F.max("component").alias("last"), F.count(F.lit(1)).alias("members")
    )
    # Two members have been compared with one another already.
    mixed = mixed.filter("first < last and members > 2").select("bucket", F.ceil(F.col("members") / BLOCK).alias("blocks"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    dealt = (
        labelled.join(mixed.hint("merge"), "bucket")
        .join(sketches.withColumnRenamed("n_shingles", "size").hint("merge"), "doc_id")
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("part", "other").cast("int"), "hi": F.greatest("part", "other").cast("int"), "part": F.col("part").cast("int")})
        .select("bucket", "lo", "hi", "part", "doc_id", "component", "size", "sketch")
    )
    pairs = dealt.groupBy("bucket", "lo", "hi").applyInPandas(lambda rows: _pairs_of_block(rows, percent), "a long, b long")
    return pairs.distinct()


def parity_join(documents: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row: doc_id, n_shingles (the set's size) and component_id.

    A set holds the distinct runs of ``width`` words of the lower-cased (A-Z) text; fewer words make one run of them
    all. Two documents are linked when ``100 * intersection >= percent * union``; component_id is the smallest doc_id
    that links reach. Null texts, and texts without words, have empty sets and reach themselves alone. Ids are taken to
    be unique; a repeated row gives the same row again, and rows with a null id are linked with nothing. An empty table
    gives no rows. Columns besides doc_id and text are not read.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digests = materialise(_digests(texts, width), "digests")
    filled = digests.filter("n_shingles > 0 and doc_id is not null")
    equal = ["n_shingles", "high", "low"]
    classes = filled.groupBy(*equal).agg(F.min("doc_id").alias("class_id"))
    # One row for each id, even if rows were repeated.
    sketches = filled.groupBy("doc_id").agg(F.min_by(F.struct("n_shingles", "sketch"), F.struct(*equal)).alias("s")).select("doc_id", "s.*")
    class_of = materialise(digests.join(classes, equal, "left").select("doc_id", "n_shingles", "class_id"), "classes")
    # Tables that grow with the input are merged at every size, never broadcast at a small one.
    by_id = class_of.filter("class_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id")).hint("merge")

    bucket = Window.partitionBy("bucket")
    crowded = _buckets(texts, width, percent).select(
        "bucket", "doc_id", F.min("doc_id").over(bucket).alias("leader"), F.max("doc_id").over(bucket).alias("last")
    )
    crowded = materialise(crowded.filter("leader < last").select("bucket", "doc_id", "leader"), "crowded")
    meetings = crowded.filter("doc_id <> leader").select("doc_id", "leader").distinct()
    meetings = meetings.join(by_id.select("doc_id", F.col("class_id").alias("x")).hint("merge"), "doc_id").join(
        by_id.select(F.col("doc_id").alias("leader"), F.col("class_id").alias("y")).hint("merge"), "leader"
    )
    pairs = meetings.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = materialise(_possible(pairs, sketches, percent), "pairs")
    links = confirmed(pairs, texts, width, percent)
    found = components(links)
    in_buckets = crowded.join(by_id, "doc_id").select("bucket", F.col("class_id").alias("doc_id")).distinct()
    across = _pairs_across_components(in_buckets, found, sketches, percent)
    across = materialise(across.join(pairs, ["a", "b"], "left_anti"), "across")
    for done in (crowded, digests, pairs):
        release(done)
    more = confirmed(across, texts, width, percent)
    if not more.isEmpty():
        found = components(links.unionByName(more))
    return class_of.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id")
    )


def one_of_each_group(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, that have the smallest id of their group of linked documents.

    A row that stands there more than once with one id and text stays once; rows with a null id stay as they are.
    """
    groups = parity_join(documents, width, percent)
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    known = documents.join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.select(documents.columns).unionByName(documents.filter("doc_id is null"))
