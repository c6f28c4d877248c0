from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from creditloom.llm import winnowing
from creditloom.llm.winnowing import POSITION_BITS, edited_fingerprints, fingerprints, hashes_of, kept_values, likeness

MASK = (1 << POSITION_BITS) - 1


def split_kept(values):
    return [(v >> POSITION_BITS, MASK - (v & MASK)) for v in values]


def test_every_window_keeps_its_rightmost_smallest_hash(spark, documents_of, odd_texts):
    rng = random.Random(2)
    texts = odd_texts + [" ".join(rng.choice("ab") for _ in range(n)) for n in (3, 5, 11, 12, 13, 60)]
    k, window = 5, 8
    kept = {r.doc_id: split_kept(r.kept) for r in fingerprints(documents_of(texts), k, window).collect()}
    for i, text in enumerate(texts):
        words = [w for w in re.split("[\x20\x09-\x0d]", text or "") if w]
        n = max(1, len(words) - k + 1) if words else 0
        # Windows of one run keep that run, so a window of 1 gives every hash with its position.
        runs = split_kept(spark.range(1).select(kept_values(F.lit(text or ""), k, 1)).first()[0])
        assert [p for _, p in runs] == list(range(n))
        if n:
            expected = []
            for s in range(max(1, n - window + 1)):
                h, p = min((h, -p) for h, p in runs[s : s + window])
                if (h, -p) not in expected:
                    expected.append((h, -p))
            assert kept[i] == expected
        else:
            assert kept[i] == []


def test_shared_words_share_a_hash(spark):
    rng = random.Random(6)
    shared = " ".join(f"s{rng.randint(0, 50)}" for _ in range(12))
    one, other = (" ".join(f"{c}{rng.randint(0, 999)}" for _ in range(40)) for c in "ab")
    row = spark.range(1).select(
        hashes_of(kept_values(F.lit(f"{one} {shared} {other}"), 5, 8)).alias("x"),
        hashes_of(kept_values(F.lit(f"{other} {shared}"), 5, 8)).alias("y"),
    ).first()
    assert set(row.x) & set(row.y)


def test_edited_texts_and_neighbours(documents_of, odd_texts, many_partitions):
    texts = [(7 * i % 101, (t or "") + " 🙂é" * (i % 4) if t is not None else None) for i, t in enumerate(odd_texts * 3)]
    found = {r.doc_id: r for r in edited_fingerprints(documents_of(texts), range_rows=4).collect()}
    order = sorted(texts, reverse=True, key=lambda x: x[0])
    assert len(found) == len(texts)
    for place, (doc, text) in enumerate(order):
        text, following = text or "", order[(place + 1) % len(order)]
        m = len(text) // 3
        edited = text[: len(text) - m] + (following[1] or "")[:m]
        assert found[doc].n_chars == len(text)
        assert found[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[doc].next_kept == found[following[0]].kept


def test_ties_missing_ids_and_few_documents(documents_of):
    rows = edited_fingerprints(documents_of([(None, "abc def"), (2, "ghi"), (2, "jkl mno")]), range_rows=1).collect()
    assert len(rows) == 3 and all(r.next_kept is not None for r in rows)
    alone = edited_fingerprints(documents_of(["one two three"])).first()
    assert alone.kept == alone.next_kept
    assert edited_fingerprints(documents_of([])).count() == 0


def test_ranges_of_a_deep_search_tree(spark):
    bounds = list(range(0, 3 * winnowing._FANOUT**2, 3))
    found = spark.range(-2, 3 * winnowing._FANOUT**2 + 1, 7).withColumn("r", winnowing._range_of(bounds, F.col("id"))).collect()
    assert all(r.r == sum(b < r.id for b in bounds) for r in found)


def test_likeness(spark):
    one, other, none = (F.array(*map(F.lit, v)).cast("array<bigint>") for v in ([1, 2, 3], [2, 3, 4], []))
    row = spark.range(1).select(likeness(one, other), likeness(one, none), likeness(none, none)).first()
    assert tuple(row) == (0.5, 0.0, 1.0)
