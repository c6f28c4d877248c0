"""The booster against brute-force searches over rows, and its parts against one another."""

from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators import attribution
from creditloom.operators import boosting as bo
from creditloom.operators.attribution import leaf_pushes
from creditloom.operators.evaluation import average_precision
from creditloom.operators.trees import Condition, Path

LABELS = ["a", "b", "c", "d"]


def generated(n, seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 6, n), rng.integers(0, 5, n)]).astype(float)
    x[rng.random(x.shape) < 0.15] = np.nan
    logit = np.nan_to_num(x[:, 0], nan=11) / 4 - 2 + np.isin(x[:, 2], [1, 3]) * 1.5 - np.isnan(x[:, 1])
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    return x, y


def table(spark, x, y):
    rows = [(i, int(b), [None if np.isnan(v) else float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, y int, x array<double>").repartition(5)


INPUTS = bo.Inputs(["n0", "n1", "kind"], [[float(v) for v in range(11)], [float(v) for v in range(5)], None], [None, None, LABELS])


def brute_tree(x, g, h, growth, rate):
    """Leaf-wise growth by trying every split of every leaf on the rows themselves; returns each row's value."""

    def worth(rows, extra=0.0):
        return max(abs(g[rows].sum()) - growth.l1, 0) ** 2 / (h[rows].sum() + growth.l2 + extra)

    def best(rows):
        found = (0.0, None)
        for j in range(3):
            column, missing = x[rows, j], np.isnan(x[rows, j])
            sides = []
            if INPUTS.cuts[j] is not None:
                for cut in INPUTS.cuts[j]:
                    sides += [column <= cut, (column <= cut) | missing]
                sides.append(~missing)
            else:
                groups = [missing] + [column == v for v in range(5)]
                groups = [s for s in groups if s.any()]
                groups.sort(key=lambda s: g[rows][s].sum() / (h[rows][s].sum() + bo.CATEGORY_SMOOTHING))
                sides += list(np.cumsum(groups, axis=0).astype(bool))
            extra = bo.CATEGORY_L2 if INPUTS.cuts[j] is None else 0.0
            for side in sides:
                left, right = rows[side], rows[~side]
                if min(len(left), len(right)) < growth.min_rows or min(h[left].sum(), h[right].sum()) < bo.LEAST_HESSIAN:
                    continue
                gain = worth(left, extra) + worth(right, extra) - worth(rows, extra)
                if gain > found[0] + 1e-9:
                    found = (gain, (left, right))
        return found

    leaves = [(np.arange(len(x)), best(np.arange(len(x))), 0)]
    while len(leaves) < growth.max_leaves:
        open_leaves = [i for i, (_, (gain, split), depth) in enumerate(leaves) if split and (not growth.max_depth or depth < growth.max_depth)]
        if not open_leaves:
            break
        i = max(open_leaves, key=lambda i: leaves[i][1][0])
        _, (_, split), depth = leaves.pop(i)
        leaves += [(rows, best(rows), depth + 1) for rows in split]
    out = np.zeros(len(x))
    for rows, _, _ in leaves:
        out[rows] = -rate * np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - growth.l1, 0) / (h[rows].sum() + growth.l2)
    return out, len(leaves)


@pytest.mark.parametrize("growth", [bo.Growth(max_leaves=7, min_rows=15), bo.Growth(max_leaves=16, max_depth=3, min_rows=5, l1=0.0, l2=1.0)])
def test_trees_equal_a_search_over_all_splits(spark, growth):
    x, y = generated(600, 4)
    model, _ = bo.fit_boosting(table(spark, x, y), None, INPUTS, growth, 3, 0.3, 10)
    margin = np.full(len(x), model.base)
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        expected, leaves = brute_tree(x, p - y, p * (1 - p), growth, 0.3)
        assert (tree.feature < 0).sum() == leaves
        assert tree.added(INPUTS.binned(x)) == pytest.approx(expected, abs=1e-6)
        margin += expected
    scored = {r["id"]: r["margin"] for r in model.margins(table(spark, x, y), ["id"]).collect()}
    assert [scored[i] for i in range(len(x))] == pytest.approx(margin.tolist(), abs=1e-6)


def test_many_tasks_grow_the_trees_of_one(spark, monkeypatch):
    x, y = generated(700, 5)
    rows, growth = table(spark, x, y), bo.Growth(max_leaves=9, min_rows=10)
    ask = lambda: bo.fit_boosting(rows, None, INPUTS, growth, 4, 0.2, 10, 0.8, 0.7, weight=3.0)[0]
    monkeypatch.setattr(bo, "STRETCH", 3)
    one = ask()
    monkeypatch.setattr(bo, "TASK_ROWS", 100)
    many = ask()
    assert len(one.trees) == len(many.trees) == 4
    for a, b in zip(one.trees, many.trees):
        assert (a.feature == b.feature).all() and (a.left == b.left).all() and (a.value == b.value).all() and (a.rows == b.rows).all()


def test_one_task_grows_the_trees_of_many_above_the_rows_of_a_task(spark, monkeypatch):
    """A table of several tasks needs no job for each level of a tree, and gives the trees that such jobs give."""
    x, y = generated(900, 8)
    rows, growth = table(spark, x, y), bo.Growth(max_leaves=12, min_rows=5)
    grown = []
    by_jobs = bo.grow_tree
    monkeypatch.setattr(bo, "grow_tree", lambda *a: grown.append(a) or by_jobs(*a))
    monkeypatch.setattr(bo, "TASK_ROWS", 200)
    ask = lambda: bo.fit_boosting(rows, None, INPUTS, growth, 5, 0.3, 10, 0.8, 0.7)[0]
    held = ask()
    assert not grown
    monkeypatch.setattr(bo, "HELD_ROWS", 100)
    by_level = ask()
    assert len(grown) == len(by_level.trees) == len(held.trees) == 5
    for a, b in zip(held.trees, by_level.trees):
        assert (a.feature == b.feature).all() and (a.left == b.left).all() and (a.value == b.value).all() and (a.rows == b.rows).all()
        assert (a.added_by_input(INPUTS.binned(x).T) == a.added(INPUTS.binned(x))).all()


def test_course_is_the_average_precision_of_every_prefix(spark, monkeypatch):
    monkeypatch.setattr(bo, "STRETCH", 4)
    x, y = generated(900, 6)
    rows = table(spark, x, y)
    fit, judged = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    model, course = bo.fit_boosting(fit, judged, INPUTS, bo.Growth(max_leaves=6, min_rows=20), 30, 0.3, 5)
    assert len(model.trees) == int(np.argmax(course)) + 1 <= len(course) - 5 or len(course) == 30
    for n in (1, 2, len(model.trees)):
        prefix = dataclasses.replace(model, trees=model.trees[:n])
        assert average_precision(prefix.margins(judged, ["y"]), score="margin").first()[0] == course[n - 1]


def test_fits_side_by_side_are_those_of_one_after_the_other(spark, monkeypatch):
    """Equal trees and courses, with one ranking for all fits, although they end at different rounds."""
    monkeypatch.setattr(bo, "STRETCH", 4)
    tables = [table(spark, *generated(n, seed)) for n, seed in ((600, 6), (900, 7), (300, 9))]
    fits = [bo.Fit(t.filter("id % 3 > 0"), t.filter("id % 3 = 0"), INPUTS, weight) for t, weight in zip(tables, (None, 2.5, None))]
    growth = bo.Growth(max_leaves=6, min_rows=20)
    expected = [bo.fit_boosting(f.train, f.judged, INPUTS, growth, 30, 0.3, 3, 0.8, 0.7, f.weight) for f in fits]
    ranked = []
    by_fit = bo.average_precision_of_each
    monkeypatch.setattr(bo, "average_precision_of_each", lambda *a, **k: ranked.append(a) or by_fit(*a, **k))
    found = bo.fit_side_by_side(fits, growth, 30, 0.3, 3, 0.8, 0.7)
    assert len(ranked) == -(-max(len(course) for _, course in expected) // 4)
    assert len({len(course) for _, course in expected}) > 1
    for (one, course), (other, courses) in zip(expected, found):
        assert one.base == other.base and course == courses and len(one.trees) == len(other.trees)
        for a, b in zip(one.trees, other.trees):
            assert (a.feature == b.feature).all() and (a.left == b.left).all() and (a.value == b.value).all() and (a.rows == b.rows).all()


def test_odd_tables(spark):
    growth = bo.Growth(min_rows=1)
    alone = bo.fit_boosting(table(spark, np.full((4, 3), np.nan), [0, 0, 1, 0]), None, INPUTS, growth, 3, 0.1, 2)[0]
    assert alone.base == pytest.approx(np.log(1 / 3))
    assert {r["margin"] for r in alone.margins(table(spark, np.full((2, 3), np.nan), [0, 1]), ["id"]).collect()} == {alone.base + sum(t.value[0] for t in alone.trees)}
    empty = table(spark, np.zeros((1, 3)), [0]).limit(0)
    assert bo.fit_boosting(empty, None, INPUTS, growth, 2, 0.1, 2)[0].margins(empty, ["id"]).count() == 0


def test_regression_tree_holds_means(spark):
    rows = spark.range(100).select("id", (F.col("id") >= 40).cast("double").alias("y"), F.array((F.col("id") / 10.0)).alias("x"))
    tree = bo.fit_regression_tree(rows, bo.Inputs(["v"], [[3.95, 7.0]], [None]), 2, 10)
    fitted = {r["fitted"] for r in tree.leaves(rows, ["id"]).filter("id < 40").collect()}
    assert len(fitted) == 1 and fitted.pop() == pytest.approx(0.0, abs=1e-7)


def test_pushes_of_a_deep_path_equal_all_coalitions():
    from itertools import combinations
    from math import factorial

    rng = np.random.default_rng(2)
    d = 9
    shares, holds = rng.random(d), rng.random((4, d)) < 0.5
    got = leaf_pushes(2.5, shares, holds.astype(float))
    for row, held in enumerate(holds):
        for j in range(d):
            others = [i for i in range(d) if i != j]
            total = 0.0
            for size in range(d):
                for known in combinations(others, size):
                    worth = np.prod([held[i] if i in known else shares[i] for i in others])
                    total += factorial(size) * factorial(d - size - 1) / factorial(d) * worth
            assert got[row, j] == pytest.approx(2.5 * (held[j] - shares[j]) * total, abs=1e-12)


def test_processes_of_one_task_grow_the_trees_of_one(spark, monkeypatch):
    """Rows and inputs shared out among processes, joint cells and small exchanges change no bit of a tree."""
    x, y = generated(900, 12)
    growth, asked = bo.Growth(max_leaves=12, min_rows=5), []
    members = bo._members
    monkeypatch.setattr(bo, "_members", lambda *a: asked.append(a) or members(*a))
    plan = [(i, chosen) for i, chosen in enumerate(([0, 1, 2], [1, 2], [0, 2]))]
    rows = bo.binned_rows(table(spark, x, y).coalesce(1), INPUTS, -1.0).toArrow().to_batches()

    class Task:
        def coalesce(self, tasks):
            return self

        def mapInArrow(self, work, schema):
            return [r for batch in work(iter(rows)) for r in batch.to_pylist()]

    one = bo._grow_in_one_task(Task(), INPUTS, growth, plan, 0.3, 0.8)
    monkeypatch.setattr(bo, "MEMBER_ROWS", 100)
    monkeypatch.setattr(bo, "_CELLS", 40)
    monkeypatch.setattr(bo, "_BLOCK", 70)
    monkeypatch.setattr(bo, "_EXCHANGED", 2)
    monkeypatch.setattr(bo.os, "sched_getaffinity", lambda _: set(range(3)))
    for cores in (1, 3):
        assert bo._grow_in_one_task(Task(), INPUTS, growth, plan, 0.3, 0.8, cores) == one
    assert bo._grow_in_one_task(Task(), INPUTS, growth, plan[:1], 0.3, 0.8, 3) == one[:1]
    assert len(one) == 3 and [members(*a) for a in asked[1:]] == [1, 2, 3]


def test_a_process_that_ends_ends_its_task(monkeypatch):
    def work():
        if team.place == 1:
            raise ValueError("in a helper")
        team.meet()
        return []

    team = bo._Team(3)
    with pytest.raises(RuntimeError, match="has ended"):
        team.run(work)


def test_many_rounds_grow_in_one_job_and_end_where_single_stretches_end(spark, monkeypatch):
    """As many rounds as patience asks for go together; the course is cut where it would have been ended stretch by stretch."""
    monkeypatch.setattr(bo, "STRETCH", 2)
    x, y = generated(900, 6)
    rows = table(spark, x, y)
    fit, judged, jobs = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0"), []
    in_one = bo._grow_in_one_task
    monkeypatch.setattr(bo, "_grow_in_one_task", lambda *a: jobs.append(a) or in_one(*a))
    ask = lambda: bo.fit_boosting(fit, judged, INPUTS, bo.Growth(max_leaves=6, min_rows=20), 40, 0.3, 9, 0.8)
    model, course = ask()
    together = len(jobs)
    monkeypatch.setattr(bo, "HELD_ROUNDS", 1)
    alone, expected = ask()
    assert course == expected and len(model.trees) == len(alone.trees)
    assert len(jobs) - together == -(-len(course) // 2) and together == -(-len(course) // 8)
    for a, b in zip(model.trees, alone.trees):
        assert (a.feature == b.feature).all() and (a.left == b.left).all() and (a.value == b.value).all()


def test_a_path_is_worked_out_once_for_all_rows(monkeypatch):
    """Whatever the rows are cut into, and also for paths too long to lay out all their patterns."""
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 6, (5, 300)).astype(np.uint8)
    path = Path(3, 1.5, [Condition(f, rng.random(6) < 0.6, s) for f, s in ((4, 0.3), (0, 0.9), (2, 0.0), (3, 0.5))])
    features = [c.feature for c in path.conditions]
    holds = np.stack([c.passes[bins[c.feature]] for c in path.conditions], axis=1).astype(float)
    expected = np.zeros(bins.shape)
    expected[features] = leaf_pushes(path.value, np.array([c.share for c in path.conditions]), holds).T
    worked_out = []
    monkeypatch.setattr(attribution, "leaf_pushes", lambda *a: worked_out.append(a) or leaf_pushes(*a))
    monkeypatch.setattr(attribution, "_BLOCK", 70)
    for laid_out, times in ((12, 1), (3, 5)):
        monkeypatch.setattr(attribution, "_LAID_OUT", laid_out)
        worked_out.clear()
        out = np.zeros(bins.shape)
        attribution._add_pushes(path, bins, out)
        assert out == pytest.approx(expected, abs=1e-15) and len(worked_out) == times


def test_contributions_of_rows_do_not_depend_on_batches(spark):
    x, y = generated(900, 13)
    rows = table(spark, x, y).coalesce(1)
    model, _ = bo.fit_boosting(rows, None, INPUTS, bo.Growth(max_leaves=8, min_rows=10), 6, 0.3, 5)

    def pushes():
        found, _ = attribution.tree_contributions(rows, model, "id")
        return {r["id"]: [(c["feature"], c["value"], c["contribution"]) for c in r["contributions"]] for r in found.collect()}

    expected = pushes()
    margins = {r["id"]: r["margin"] for r in model.margins(rows, ["id"]).collect()}
    base = attribution.tree_contributions(rows, model, "id")[1]
    assert {i: base + sum(c for *_, c in found) for i, found in expected.items()} == pytest.approx(margins, abs=1e-9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        assert pushes() == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fits_that_remain_share_the_cores(spark, monkeypatch):
    """Fits that grow side by side leave one another's cores alone, and take those of fits that have ended."""
    monkeypatch.setattr(bo, "STRETCH", 4)
    monkeypatch.setattr(bo, "_cores", lambda _: 6)
    given, in_one = [], bo._grow_in_one_task
    monkeypatch.setattr(bo, "_grow_in_one_task", lambda *a: given.append(a[-1]) or in_one(*a))
    tables = [table(spark, *generated(n, seed)) for n, seed in ((600, 6), (900, 7), (300, 9))]
    fits = [bo.Fit(t.filter("id % 3 > 0"), t.filter("id % 3 = 0"), INPUTS) for t in tables]
    found = bo.fit_side_by_side(fits, bo.Growth(max_leaves=6, min_rows=20), 30, 0.3, 3, 0.8, 0.7)
    stretches = [-(-len(course) // 4) for _, course in found]
    going = [sum(s > i for s in stretches) for i in range(max(stretches))]
    assert len(set(going)) > 1 and given == [6 // n for n in going for _ in range(n)]
