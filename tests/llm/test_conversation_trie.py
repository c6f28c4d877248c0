from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from creditloom.llm import conversation_trie as ct
from creditloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth string, block string, up_conv string, at string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "b", "u", "a") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        paths[c] = path
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(c for c in convs if paths[c] == p))).encode()).hexdigest(),
        )
        for p, convs in members.items()
    )


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[:2])


def random_rows(seed, n=260):
    """A frequent first turn, equal conversations, one long chain and missing bases."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 900), n):
        turns = ["hello"] * (rng.random() < 0.4) + [rng.choice("abc") * rng.randint(0, 3) for _ in range(rng.randint(0, 7))]
        rows += [(c, i if i else rng.choice([0, None]), "user" if i % 2 else "bot", t) for i, t in enumerate(turns)]
    rows += [(901, i, "user", f"t{i}") for i in range(150)]
    return rows


@pytest.mark.parametrize(("seed", "held"), [(1, 1 << 15), (2, 24), (3, 3)])
def test_equals_brute_force(spark, many_partitions, monkeypatch, seed, held):
    """Also with components split by joins, down to a few nodes."""
    monkeypatch.setattr(ct, "HELD", held)
    rows = random_rows(seed)
    assert found(ct.conversation_trie(table(spark, rows))) == brute(rows)


def test_odd_conversations(spark):
    rows = [
        (100, 0, "user", "a"), (100, 1, None, None), (101, None, "user", "a"), (101, 5, "", ""), (102, 0, "user", "x" * 100_000), (203, 0, "u", "v"),
        (204, 1, "u", "🙂🙂"), (204, 2, "u", "🙂🙂"), (None, 0, "u", "lost"), (-7, 3, "u", "negative"), (305, 0, "u", "w"),
    ]
    kept = [r for r in rows if r[0] != -7]
    assert found(ct.conversation_trie(table(spark, kept))) == brute(kept)
    assert ct.conversation_trie(table(spark, rows)).filter("conv_id = -7").count() > 0
    repeated = [(500, 0, "u", "a"), (500, 0, "u", "a"), (500, 1, "u", "b")] * 2
    assert found(ct.conversation_trie(table(spark, repeated))) == brute(repeated)
    assert found(ct.conversation_trie(table(spark, []))) == []
    alone = [(301, 0, "u", "a")]
    assert zlib.crc32(b"301") % 6 > 0
    assert found(ct.conversation_trie(table(spark, alone))) == brute(alone)


def test_rollup_of_random_forests():
    rng = np.random.default_rng(4)
    for n, reach in ((1, 1), (300, 300), (300, 3), (400, 1)):
        up = np.array([-1 if i == 0 or rng.random() < 0.02 else int(rng.integers(max(0, i - reach), i)) for i in range(n)])
        depth = np.zeros(n, np.int64)
        for i in range(n):
            depth[i] = depth[up[i]] + 1 if up[i] >= 0 else 0
        values = rng.integers(0, 100, (n, 2))
        size, sums = np.ones(n, np.int64), values.copy()
        for i in reversed(range(n)):
            if up[i] >= 0:
                size[up[i]] += size[i]
                sums[up[i]] += sums[i]
        mixed = rng.permutation(n)
        place = np.argsort(mixed)
        moved = np.where(up[mixed] >= 0, place[up[mixed]], -1)
        assert (ct.rolled_up(moved, depth[mixed], size[mixed], values[mixed]) == sums[mixed]).all()


def test_query_equals_brute_force_on_the_given_table(spark):
    from tests.conftest import SF

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_conversation_trie"](spark, SF)) == brute(rows)
