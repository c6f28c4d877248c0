from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from creditloom.functions import spread_hash
from creditloom.operators import sampling
from creditloom.operators.restriction import restrict_to_clients
from creditloom.sources.testbed import Testbed
from tests.conftest import SF, plan_of


@pytest.fixture(scope="module")
def clients(spark):
    i = F.col("id")
    return spark.range(5000).select((i * 3 + 11).alias("SK_ID_CURR"), (i % 12 == 0).cast("long").alias("TARGET"))


def by_hash(df):
    ranked = df.select("SK_ID_CURR", "TARGET", spread_hash("SK_ID_CURR").alias("h")).collect()
    order = {0: [], 1: []}
    for r in sorted(ranked, key=lambda r: (r["h"], r["SK_ID_CURR"])):
        order[r["TARGET"]].append(r["SK_ID_CURR"])
    return order


def ids(df):
    return {r["SK_ID_CURR"] for r in df.collect()}


def test_sample_keeps_the_shares_and_follows_the_hash(clients):
    order = by_hash(clients)
    got = ids(sampling.stratified_sample(clients, 600))
    assert got == set(order[0][:550]) | set(order[1][:50])
    assert ids(sampling.stratified_sample(clients.repartition(9), 600)) == got


def test_every_stratum_keeps_a_row(clients):
    rare = clients.filter("TARGET = 0 OR SK_ID_CURR = 11")
    assert Counter(r["TARGET"] for r in sampling.stratified_sample(rare, 3).collect())[1] == 1


def test_rank_covers_each_stratum(clients):
    order = by_hash(clients)
    for r in sampling.stratified_rank(clients).collect():
        assert order[r["TARGET"]][r["rn"] - 1] == r["SK_ID_CURR"]
        assert (r["stratum_n"], r["total_n"]) == (len(order[r["TARGET"]]), 5000)


def test_splits_are_stratified_disjoint_and_order_free(clients):
    split = sampling.assign_split(clients)
    sizes = Counter((r["TARGET"], r["split"]) for r in split.collect())
    positives = sum(n for (y, _), n in sizes.items() if y == 1)
    assert sizes[1, "test"] == round(positives * 0.1) and sizes[0, "early_stop"] > 0
    assert sum(sizes.values()) == 5000
    again = sampling.assign_split(clients.orderBy(F.desc("SK_ID_CURR")))
    assert {tuple(r) for r in split.collect()} == {tuple(r) for r in again.collect()}


def test_assigning_a_split_moves_no_rows(clients):
    assert "Exchange" not in plan_of(sampling.assign_split(clients))


def test_folds_are_balanced(clients):
    sizes = Counter((r["TARGET"], r["fold"]) for r in sampling.assign_fold(clients).collect())
    for y in (0, 1):
        per_fold = [sizes[y, f] for f in range(1, 6)]
        assert max(per_fold) - min(per_fold) <= 1


def test_undersampling_and_weights(clients):
    kept = Counter(r["TARGET"] for r in sampling.undersample_majority(clients).collect())
    assert kept[0] == kept[1] == 417
    weight = sampling.positive_weight(clients)
    assert weight == pytest.approx((5000 - 417) / 417)



def test_hash_is_even(spark):
    shares = spark.range(100_000).groupBy((spread_hash("id") % 10).alias("b")).count().collect()
    assert all(abs(r["count"] - 10_000) < 500 for r in shares)


def test_cascade_keeps_referential_integrity(spark):
    t = Testbed(spark, SF)
    chosen = sampling.stratified_sample(t["application_train"], 50)
    kept = restrict_to_clients(t, chosen)
    wanted = ids(chosen)
    assert ids(kept["bureau"]) <= wanted
    credits = {r["SK_ID_BUREAU"] for r in kept["bureau"].collect()}
    assert {r["SK_ID_BUREAU"] for r in kept["bureau_balance"].collect()} <= credits


def test_many_strata_and_rows_without_a_label(spark):
    i = F.col("id")
    stratum = F.when(i % 10 > 0, i % 300).cast("long")
    df = spark.range(20_000).select(i.alias("SK_ID_CURR"), stratum.alias("TARGET"))
    folded = sampling.assign_fold(df, 5).collect()
    assert {r["fold"] for r in folded if r["TARGET"] is None} == {None}
    sizes = Counter((r["TARGET"], r["fold"]) for r in folded if r["TARGET"] is not None)
    for s in {s for s, _ in sizes}:
        own = [sizes[s, f] for f in range(1, 6)]
        assert max(own) - min(own) <= 1
    split = sampling.assign_split(df)
    assert split.filter("TARGET IS NULL AND split IS NOT NULL").count() == 0
    assert split.filter("TARGET IS NOT NULL AND split IS NULL").count() == 0
    assert sampling.stratified_sample(df, 2000).filter("TARGET IS NULL").count() == 0
