from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditloom.operators.ordering import global_ntile, global_position, running_totals
from creditloom.operators import quantiles
from creditloom.operators.quantiles import exact_quantiles
from tests.conftest import plan_of


def tiles(n, k):
    small, large = divmod(n, k)
    return [t + 1 for t in range(min(n, k)) for _ in range(small + (t < large))]


@pytest.mark.parametrize("n", [1, 3, 10, 97, 1000])
def test_ntile_with_a_dominant_value(spark, many_partitions, n):
    rng = random.Random(n)
    data = [(i, 0.5 if rng.random() < 0.4 else rng.random()) for i in range(n)]
    df = spark.createDataFrame(data, "id long, x double")
    got = global_ntile(df, 10, [F.col("x").asc(), F.col("id").asc()]).collect()
    expected = dict(zip([i for i, _ in sorted(data, key=lambda r: (r[1], r[0]))], tiles(n, 10)))
    assert {r["id"]: r["tile"] for r in got} == expected


def test_positions_and_running_totals(spark, many_partitions):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("v"))
    ordered = sorted(((r["x"], r["v"]) for r in df.collect()), reverse=True)
    total, expected = 0, {}
    for position, (x, v) in enumerate(ordered):
        expected[x] = (position, total)
        total += v
    placed = {r["x"]: r["position"] for r in global_position(df, [F.col("x").desc()]).collect()}
    summed = running_totals(df, [F.col("x").desc()], ["v"]).collect()
    assert placed == {x: p for x, (p, _) in expected.items()}
    assert {r["x"]: r["v_before"] for r in summed} == {x: t for x, (_, t) in expected.items()}
    assert {r["v_total"] for r in summed} == {total}


def test_no_single_task_handles_the_rows(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 10)
    plan = plan_of(df.repartitionByRange("x", "id").sortWithinPartitions("x", "id"))
    assert "rangepartitioning" in plan and "SinglePartition" not in plan
    # What is left to one task starts from a count per partition, after the stored rows were aggregated.
    final = plan_of(global_position(df, [F.col("x").asc(), F.col("id").asc()]))
    for part in final.split("Exchange SinglePartition")[1:]:
        assert part.index("HashAggregate") < part.index("FileScan")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_quantiles_of_small_columns(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    known = [float(v) for v in values if v is not None]
    got = {r["probability"]: r["value"] for r in exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    if not known:
        assert got == {}
    for p, value in got.items():
        assert value == pytest.approx(np.quantile(known, p), rel=1e-12, abs=1e-9)


def test_quantiles_of_a_large_column(spark, many_partitions):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 0.37 % 100).alias("x"))
    values = np.array([r[0] for r in df.collect()])
    got = {r["probability"]: r["value"] for r in exact_quantiles(df, ["x"], [0.05, 0.5, 0.99]).collect()}
    for p in (0.05, 0.5, 0.99):
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)


@pytest.mark.parametrize("kind", ["distinct", "frequent"])
def test_brackets_are_narrowed_until_few_values_are_left(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "_ACCURACY", 200)
    monkeypatch.setattr(quantiles, "_BRACKET", 60)
    seen = []
    narrowed = quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda numbers, asked: seen.append(narrowed(numbers, asked)) or seen[-1])
    x = np.random.default_rng(1).permutation(30_000) * 0.5
    if kind == "frequent":
        x[:20_000] = 77.0
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    asked = [0.0, 0.031, 0.5, 0.77, 1.0]
    got = {r["probability"]: r["value"] for r in exact_quantiles(df, ["x"], asked).collect()}
    assert got == {p: pytest.approx(float(np.quantile(x, p)), abs=1e-9) for p in asked}
    for _, _, low, high in seen[0]:
        assert len(np.unique(x[(x >= low) & (x <= high)])) <= 60
