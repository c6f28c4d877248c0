from __future__ import annotations

import random
import zlib
from collections import Counter

from creditloom.llm.sharding import shards


def check(rows, texts, n):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts
    )
    sizes, slots = [0] * n, [[] for _ in range(n)]
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean, largest = sum(sizes) / n, max(len((t or "").encode()) + 16 for _, t in texts)
    assert all(abs(s - mean) <= 2 * largest for s in sizes)


def test_balanced_whatever_the_partitions(documents_of, odd_texts, many_partitions):
    rng = random.Random(8)
    texts = [(i, "x" * rng.randint(0, 300)) for i in range(700)] + [(1000 + i, "a copy of a text") for i in range(600)]
    check(shards(documents_of(texts), 7).collect(), texts, 7)
    odd = list(enumerate(odd_texts))
    check(shards(documents_of(odd + odd), 3).collect(), odd + odd, 3)


def test_small_groups_stay_together(documents_of):
    rng = random.Random(9)
    texts = [f"text {i} " + "y" * rng.randint(50, 90) for i in range(300)]
    rows = shards(documents_of([(i, t) for i, t in enumerate(texts * 2 + ["z" * 2000])]), 10).collect()
    where = {}
    for r in rows:
        where.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_few_and_no_documents(documents_of):
    assert shards(documents_of([]), 5).count() == 0
    assert {r.shard for r in shards(documents_of(["one", "two"]), 40).collect()} <= set(range(40))
    assert shards(documents_of([(None, None)]), 4).collect()[0].slot == 0
