"""Removal of byte strings that an earlier document holds, by suffixes that are compared through prefix hashes.

Every string of ``length`` bytes has an anchor: of its 16-byte grams the one with the smallest hash, the rightmost of
equal ones. Equal strings have equal anchors at equal places, so strings need only be compared with strings of the same
anchor. Neighbouring strings of a document share their anchor; such a run is what is sent around.

1. Anchors: a run is sent as (hash of the anchor gram, hash of the run's bytes). A run whose bytes an earlier document
   has too is removed as a whole. Runs whose anchor earlier or later documents have in other surroundings stay open: these
   are the ends of what documents share. Nothing more is done with all others.
2. Suffixes: the bytes of the open runs are fetched. Every string is a suffix of its run, cut at ``length``. The suffixes
   of one anchor that begin and end with the same 8 bytes are put in order by a merge sort that compares two of them in logarithmic time: polynomial prefix hashes
   and a binary search find their common extension. Neighbours that agree in ``length`` bytes form a class, which is
   verified byte by byte; a string is removed if its class has one in an earlier document.
3. The removed stretches are joined to the documents and cut out.

Equal runs inside one slice of the input are merged before anything is shuffled, so a passage that very many documents
share is sent once for each slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.text import PrefixHash, mix, pieces, text_bytes
from creditloom.sources.intermediate import materialise

GRAM = 16
# A bucket of anchors holds those of about so many bytes of text.
BUCKET_BYTES = 12 << 20
# What stands for bytes that are no character.
_BROKEN = "\ufffd"
_PLACE_BITS = np.uint64(32)
# Strings that are sorted at a time, unless one anchor has more.
LOT = 100_000
_KEY_BYTES, _RUN_BYTES, _START_BYTES = 5, 6, 4


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The runs of strings with one anchor: row, start, end (of their bytes), anchor hash and hash of the bytes."""
    n_windows = len(data) - length + 1
    if n_windows <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = PrefixHash(data)
    place = np.arange(len(data) - GRAM + 1)
    grams = hashes.ranges(place, place + GRAM)
    # The gram's place counts down in the low bits, so the smallest number is the rightmost smallest hash.
    lowest = ((grams >> _PLACE_BITS) << _PLACE_BITS) | (np.uint64(len(data)) - place.astype(np.uint64))
    covered, grams_each = 1, length - GRAM + 1
    while covered < grams_each:
        step = min(covered, grams_each - covered)
        lowest = np.minimum(lowest[:-step], lowest[step:])
        covered += step
    anchor = len(data) - (lowest & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n_windows]
    starts = np.flatnonzero(np.arange(n_windows) + length <= offsets[1:][row])
    if not len(starts):
        return runs_of(data[:0], offsets[:1], length)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[starts[1:]] != anchor[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    begin = starts[first]
    end = starts[np.append(first[1:], len(starts)) - 1] + length
    return row[begin], begin, end, grams[anchor[begin]], hashes.ranges(begin, end)


def _planes(values: np.ndarray, n_bytes: int) -> bytes:
    """Numbers as ``n_bytes`` byte planes: the planes of high bytes are nearly constant and compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def _numbers(planes: bytes, n_bytes: int) -> np.ndarray:
    out = np.zeros((len(planes) // n_bytes, 8), np.uint8)
    out[:, :n_bytes] = np.frombuffer(planes, np.uint8).reshape(n_bytes, -1).T
    return out.view("<u8").ravel()


_ANCHORS = "bucket long, ids binary, counts binary, starts binary, sizes binary, keys binary, runs binary, done binary"


def _anchors(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """Runs by bucket, many in one row; ``done`` has those that an earlier document of the same slice has too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, most_bytes=1 << 20):
                data, offsets = text_bytes(part.column("text"))
                row, begin, end, key, run = runs_of(data, offsets, length)
                doc = part.column("doc_id").to_numpy()[row]
                start = begin - offsets[:-1][row]
                size = end - begin
                bucket = (key >> np.uint64(40)) % np.uint64(buckets)
                order = np.lexsort((doc, run, key))
                same = np.zeros(len(order), bool)
                same[1:] = (key[order[1:]] == key[order[:-1]]) & (run[order[1:]] == run[order[:-1]])
                leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                later = np.zeros(len(order), bool)
                later[order] = doc[order] > doc[order[leader]]
                order = np.lexsort((start, doc, bucket))
                out = []
                for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    if not len(at):
                        continue
                    done, at_hand = at[later[at]], at[~later[at]]
                    ids, counts = np.unique(doc[at_hand], return_counts=True)
                    finished = np.stack([doc[done], start[done], size[done]]) if len(done) else np.zeros(0, np.int64)
                    out.append((
                        int(bucket[at[0]]), ids.tobytes(), counts.astype("<u4").tobytes(),
                        _planes(start[at_hand], _START_BYTES), _planes(size[at_hand] - length, 1),
                        _planes(key[at_hand], _KEY_BYTES), _planes(run[at_hand], _RUN_BYTES), finished.tobytes(),
                    ))
                if out:
                    types = [pa.int64(), *[pa.binary()] * 7]
                    names = [f.split()[0] for f in _ANCHORS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return texts.mapInArrow(send, _ANCHORS)


def _judged(rows: list[dict], bucket: int, length: int) -> Iterator[pa.RecordBatch]:
    """The runs of one bucket that an earlier document has (key is null), and the open ones with their key."""
    doc = np.concatenate([np.repeat(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], "<u4")) for r in rows])
    start = np.concatenate([_numbers(r["starts"], _START_BYTES) for r in rows]).astype(np.int64)
    size = np.concatenate([_numbers(r["sizes"], 1) for r in rows]).astype(np.int64) + length
    key = np.concatenate([_numbers(r["keys"], _KEY_BYTES) for r in rows])
    run = np.concatenate([_numbers(r["runs"], _RUN_BYTES) for r in rows])
    order = np.lexsort((doc, run, key))
    doc, start, size, key, run = (x[order] for x in (doc, start, size, key, run))
    new_key, new_run = np.ones(len(key), bool), np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_run[1:] = new_key[1:] | (run[1:] != run[:-1])
    if len(key):
        # A run's first document is its smallest; an anchor is open if its runs' first documents differ.
        first_of_run = doc[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
        heads = np.flatnonzero(new_key)
        group = np.cumsum(new_key) - 1
        open_key = (np.minimum.reduceat(first_of_run, heads) < np.maximum.reduceat(first_of_run, heads))[group]
        removed = doc > first_of_run
        undecided = open_key & ~removed
    else:
        removed = undecided = np.zeros(0, bool)
    done = [np.frombuffer(r["done"], np.int64).reshape(3, -1) for r in rows]
    docs = np.concatenate([doc[removed], *(d[0] for d in done), doc[undecided]])
    starts = np.concatenate([start[removed], *(d[1] for d in done), start[undecided]])
    sizes = np.concatenate([size[removed], *(d[2] for d in done), size[undecided]])
    shown = (key[undecided] | (np.uint64(bucket) << np.uint64(40))).view(np.int64)
    keys = pa.concat_arrays([pa.nulls(len(docs) - len(shown), pa.int64()), pa.array(shown)])
    if len(docs):
        columns = [pa.array(docs), pa.array(starts, pa.int32()), pa.array(sizes, pa.int16()), keys]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "size", "key"])


def _judge(anchors: DataFrame, length: int) -> DataFrame:
    """Each bucket is judged by itself; rows come sorted, so one bucket is in memory at a time."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for bucket, own in groupby(rows, key=lambda row: row["bucket"]):
            yield from _judged(list(own), bucket, length)

    return anchors.mapInArrow(judge, "doc_id long, start int, size short, key long")


class Suffixes:
    """Suffixes of one byte buffer, compared over ``length`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int, hashes: PrefixHash | None = None) -> None:
        self.data, self.length = data, length
        self.hashes = hashes or PrefixHash(data)

    def common(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The common extension of pairs of suffixes, at most ``length``, by binary search."""
        whole = self.hashes.ranges(one, one + self.length) == self.hashes.ranges(other, other + self.length)
        low = np.where(whole, self.length, 0)
        high = np.where(whole, self.length, self.length - 1)
        while True:
            active = np.flatnonzero(low < high)
            if not len(active):
                return low
            a, b = one[active], other[active]
            middle = (low[active] + high[active] + 1) >> 1
            equal = self.hashes.ranges(a, a + middle) == self.hashes.ranges(b, b + middle)
            low[active] = np.where(equal, middle, low[active])
            high[active] = np.where(equal, high[active], middle - 1)

    def less(self, one: np.ndarray, other: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffixes come before others, or are equal where that counts too."""
        shared = self.common(one, other)
        inside = shared < self.length
        at = np.where(inside, shared, 0)
        return np.where(inside, self.data[one + at] < self.data[other + at], or_equal)

    def sort(self, suffixes: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """The order of the suffixes inside their groups (equal numbers that stand together), by merge sort.

        All merges of one width are done at once: a suffix's new place is its place in its own run plus its rank in the
        neighbouring run, found by binary search.
        """
        n = len(suffixes)
        order = np.arange(n)
        heads = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if n else np.zeros(0, np.int64)
        counts = np.diff(np.append(heads, n))
        group = np.repeat(np.arange(len(heads)), counts)
        width = 1
        while len(counts) and counts.max() > width:
            place = np.flatnonzero((counts > width)[group])
            head, stop = heads[group[place]], (heads + counts)[group[place]]
            run = (place - head) // width
            right = run % 2 == 1
            begin = head + (run ^ 1) * width
            low, high = np.minimum(begin, stop), np.minimum(begin + width, stop)
            begin = low.copy()
            while True:
                active = np.flatnonzero(low < high)
                if not len(active):
                    break
                middle = (low[active] + high[active]) >> 1
                mine, theirs = suffixes[order[place[active]]], suffixes[order[middle]]
                after = self.less(theirs, mine, right[active])
                low[active] = np.where(after, middle + 1, low[active])
                high[active] = np.where(after, high[active], middle)
            rank = low - begin
            merged = head + (run // 2) * 2 * width + (place - head - run * width) + rank
            order[merged] = order[place].copy()
            width *= 2
        return order

    def classes(self, suffixes: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """A number for every suffix, equal for equal strings of one group; hash collisions are found and mended."""
        order = self.sort(suffixes, groups)
        equal = np.zeros(len(order), bool)
        a, b = suffixes[order[:-1]], suffixes[order[1:]]
        equal[1:] = (groups[order[1:]] == groups[order[:-1]]) & (self.common(a, b) == self.length)
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(~equal)
        checked = np.flatnonzero(equal)
        wrong: set[int] = set()
        for some in np.array_split(checked, len(checked) // 20_000 + 1):
            span = np.arange(self.length)
            one, other = suffixes[order[some - 1]], suffixes[order[some]]
            differ = (self.data[one[:, None] + span] != self.data[other[:, None] + span]).any(axis=1)
            wrong.update(groups[order[some[differ]]].tolist())
        fresh = len(order) + 1
        for group in wrong:  # two different strings had one hash
            names: dict[bytes, int] = {}
            for i in np.flatnonzero(groups == group):
                string = self.data[suffixes[i] : suffixes[i] + self.length].tobytes()
                out[i] = names.setdefault(string, fresh + len(names))
            fresh += len(names)
        return out


def _strings_removed(rows: pa.Table, length: int) -> pa.RecordBatch | None:
    """The stretches of open runs whose strings an earlier document has; ``rows`` hold whole keys."""
    data, offsets = text_bytes(rows.column("bytes").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
    n_strings = np.diff(offsets) - length + 1
    run = np.repeat(np.arange(len(n_strings)), n_strings)
    inside = np.arange(n_strings.sum()) - np.repeat(np.cumsum(n_strings) - n_strings, n_strings)
    doc = rows.column("doc_id").to_numpy()[run]
    # Equal strings begin and end alike: only strings of one anchor with the same 8 bytes at both ends are sorted.
    eights = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        eights |= data[i : len(data) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    begin = offsets[run] + inside
    alike = mix(rows.column("key").to_numpy().view(np.uint64))[run]
    alike = mix(mix(alike + eights[begin]) + eights[begin + length - 8])
    order = np.argsort(alike, kind="stable")
    alike = alike[order]
    group = np.cumsum(np.append(True, alike[1:] != alike[:-1]))
    several = np.bincount(group)[group] > 1
    order, group = order[several], group[several]
    if not len(order):
        return None
    suffixes = Suffixes(data, length)
    where = begin[order]
    gone = []
    at = 0
    while at < len(order):  # whole groups, about LOT strings at a time
        end = int(np.searchsorted(group, group[min(at + LOT, len(order)) - 1], side="right"))
        lot = order[at:end]
        number = suffixes.classes(where[at:end], group[at:end])
        by_class = np.lexsort((doc[lot], number))
        lot, number = lot[by_class], number[by_class]
        new = np.append(True, number[1:] != number[:-1])
        first = doc[lot][np.flatnonzero(new)][np.cumsum(new) - 1]
        gone.append(lot[doc[lot] > first])
        at = end
    gone = np.sort(np.concatenate(gone))
    if not len(gone):
        return None
    joined = np.ones(len(gone), bool)
    joined[1:] = (run[gone[1:]] != run[gone[:-1]]) | (gone[1:] != gone[:-1] + 1)
    head = np.flatnonzero(joined)
    count = np.diff(np.append(head, len(gone)))
    starts = rows.column("start").to_numpy()[run[gone[head]]] + inside[gone[head]]
    columns = [pa.array(doc[gone[head]]), pa.array(starts, pa.int32()), pa.array(count + length - 1, pa.int16())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "size"])


def _open_runs(texts: DataFrame, judged: DataFrame, length: int) -> DataFrame:
    """key, doc_id, start and bytes of every open run."""
    wanted = judged.filter("key is not null").groupBy("doc_id").agg(
        F.collect_list(F.struct("key", "start", "size")).alias("runs")
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: tuple[list, ...] = ([], [], [], [])
                for doc, packed, keys, starts, sizes in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    raw = unpack.decompress(packed)
                    for column, values in zip(out, (keys, [doc] * len(keys), starts, [raw[s : s + n] for s, n in zip(starts, sizes)])):
                        column.extend(values)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["key", "doc_id", "start", "bytes"])

    schema = "key long, doc_id long, start int, bytes binary"
    joined = texts.join(wanted, "doc_id").select("doc_id", "packed", "runs.key", "runs.start", "runs.size")
    return joined.mapInArrow(fetch, schema)


def _resolve(opened: DataFrame, length: int) -> DataFrame:
    """The stretches that step 2 removes. Rows come sorted by key; whole keys are taken a few thousand rows at a time."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 4096:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                found = _strings_removed(rows.slice(0, whole), length)
                if found is not None:
                    yield found
                held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            found = _strings_removed(pa.Table.from_batches(held), length)
            if found is not None:
                yield found

    ordered = opened.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(resolve, "doc_id long, start int, size short")


def _packed(documents: DataFrame) -> DataFrame:
    """Texts as compressed bytes, so that they are small when they are shuffled; ``carried`` stays as it is."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [packer.compress(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
            columns = [batch.column("doc_id"), pa.array(packed, pa.binary()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "packed", *batch.schema.names[2:]])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("packed", T.BinaryType())])
    return documents.mapInArrow(pack, T.StructType(schema.fields + documents.schema.fields[2:]))


def _stretches(starts: list[int], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal removed runs."""
    begin = np.array(starts, np.int64)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate((begin + np.array(sizes, np.int64))[order])
    new = np.append(True, begin[1:] > end[:-1])
    last = np.append(new[1:], True)
    return begin[new], end[last]


_RESULT = "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"


def _cut_out(joined: DataFrame, carried: list[T.StructField]) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                lot = batch.slice(at, 256)
                out = []
                for doc, packed, starts, sizes in zip(*(c.to_pylist() for c in lot.columns[:4])):
                    raw = unpack.decompress(packed)
                    if not starts:
                        out.append((doc, len(raw), 0, [], [], raw))
                        continue
                    begin, end = _stretches(starts, sizes)
                    edges = zip(np.append(0, end).tolist(), np.append(begin, len(raw)).tolist())
                    kept = b"".join(raw[a:b] for a, b in edges)
                    out.append((doc, len(raw), len(raw) - len(kept), begin.tolist(), end.tolist(), kept))
                types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
                names = [f.split()[0] for f in _RESULT.split(", ")] + lot.schema.names[4:]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] + lot.columns[4:]
                yield pa.RecordBatch.from_arrays(columns, names)

    chosen = joined.select("doc_id", "packed", "found.start", "found.size", *[f.name for f in carried])
    return chosen.mapInArrow(cut, T.StructType(T.StructType.fromDDL(_RESULT).fields + carried))


def suffix_dedup(documents: DataFrame, length: int = 50, carry: bool = False) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, starts and ends of the removed byte runs, kept (bytes).

    Every byte of a string of ``length`` bytes that also starts in a document with a smaller doc_id is removed; strings
    are judged on the texts as given, overlaps count, and matches never cross documents. ``length`` lies between 20 and
    270. A null text is empty; texts below ``length`` bytes lose nothing. Ids are taken to be unique; equal rows lose the
    same. Rows with a null id lose nothing and take nothing. No documents give no rows. ``carry`` adds each row's other
    columns as they are, in a column ``carried``; else they are not read.
    """
    others = [c for c in documents.columns if c not in ("doc_id", "text")]
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct(*others).alias("carried")] if carry and others else [])
    )
    known = texts.filter("doc_id is not null and text is not null").select("doc_id", "text")
    n_bytes = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = n_bytes // BUCKET_BYTES + 1
    anchors = _anchors(known, length, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    judged = materialise(_judge(anchors, length), "judged")
    later = materialise(_resolve(_open_runs(_packed(known), judged, length), length), "stretches")
    found = judged.filter("key is null").select("doc_id", "start", "size").unionByName(later)
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("found"))
    return _cut_out(_packed(texts).join(found.hint("merge"), "doc_id", "left"), texts.schema.fields[2:])


def deduplicated(documents: DataFrame, length: int = 50) -> DataFrame:
    """The documents with their columns, the removed stretches cut out of their texts and n_chars, if there is one, anew.

    Bytes of a character that was cut in two are dropped.
    """
    cut = suffix_dedup(documents, length, carry=True)

    def column(name: str):
        if name == "text":
            return F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), _BROKEN, "")
        return F.col(name) if name == "doc_id" else F.col(f"carried.`{name}`")

    out = cut.select([column(c).cast(documents.schema[c].dataType).alias(c) for c in documents.columns])
    if "n_chars" not in documents.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
