from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import hard_negatives as hn
from creditloom.llm.queries import QUERIES

SCHEMA = "vec_id long, label long, q array<long>, slice string, anchor string, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", "a", "x") for r in rows], SCHEMA).repartition(3)


def brute(rows, every, n_positives=5, n_negatives=3, low=50, high=95):
    one = {}
    for i, label, q in rows:
        if i is None or label is None or q is None or any(x is None for x in q):
            continue
        one[i] = min(one[i], (label, q)) if i in one else (label, q)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in one.items():
        if a % every:
            continue
        scored = sorted((-dot(q, other), i, l) for i, (l, other) in one.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:n_positives]:
            good = [(t, n) for t, n, l in scored if l != label and low * -s <= 100 * -t <= high * -s][:n_negatives]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n) in enumerate(good, 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_tables_and_planes_give_inner_products():
    rng = np.random.default_rng(1)
    for spread, d in ((1, 8), (200, 64), (1 << 20, 13), (1 << 40, 3)):
        a, v = rng.integers(-spread, spread + 1, (5, d)), rng.integers(-spread, spread + 1, (40, d))
        v[0], v[1] = -spread, spread
        assert (hn.inner_products(hn.subset_tables(a), hn.bit_planes(v)) == v @ a.T).all()
    assert (hn.inner_products(hn.subset_tables(a), hn.bit_planes(np.zeros((3, 3), np.int64))) == 0).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    """Several slices and blocks, a hot vector, ties and one label with a third of all rows."""
    monkeypatch.setattr(hn, "SLICE", 64)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 3)
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        q = rng.integers(-6, 9, 11) if i % 3 else np.arange(11) - 3
        rows.append((i * 3, int(rng.integers(0, 4)) if i % 5 else 1, [int(x) for x in q]))
    assert found(hn.hard_negatives(table(spark, rows), F.col("vec_id") % 7 == 0)) == brute(rows, 7)


def test_odd_rows(spark):
    rows = [
        (0, 1, [3, 4]), (1, 1, [3, 3]), (2, 1, [1]), (3, 2, [2, 3]), (3, 2, [2, 3]), (4, 2, [2, 2, 9]), (5, 2, []), (6, 0, [1, 1]),
        (None, 1, [9, 9]), (7, None, [9, 9]), (8, 1, None), (9, 1, [9, None]), (0, 2, [8, 8]), (50, 7, [1, 1]), (100, 1, [-3, -4]),
    ]
    assert found(hn.hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0)) == brute(rows, 50)
    assert found(hn.hard_negatives(table(spark, []), F.col("vec_id") % 50 == 0)) == []
    assert found(hn.hard_negatives(table(spark, rows), F.lit(False))) == []


def test_components_become_whole_numbers(spark):
    data = [(1, 0, [0.5, -0.001, 0.0039]), (2, 0, None), (3, 0, [1.0, None]), (4, 0, [float("nan")]), (5, 0, [float("-inf")]), (6, 0, [])]
    df = spark.createDataFrame(data, "vec_id long, label long, embedding array<float>")
    assert {r.vec_id: r.q for r in hn.whole_numbers(df).collect()} == {1: [128, -1, 0], 6: []}


def test_query_equals_brute_force_on_the_given_table(spark):
    from tests.conftest import SF

    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    planted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = [tuple(r) for r in hn.whole_numbers(vectors.withColumn("label", planted)).collect()]
    assert found(QUERIES["op12_hard_negatives"](spark, SF)) == brute(rows, 50)
