from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_decontamination import best_distance
from tests.llm.test_parity_join import brute as brute_groups
from tests.llm.test_suffix_dedup import brute as brute_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gets and gives, stored in between."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((name, docs.collect(), result.collect(), result.columns))
        docs = result
    return out


def test_names_order_and_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "near_duplicates", "repeated_passages", "benchmark_passages", "sequences"]
    assert all(sorted(s[3]) == sorted(COLUMNS) for s in stages[:-1])
    assert all(s[2] for s in stages)


def test_toxicity_drops_whole_rows_only(stages):
    _, before, after, _ = stages[0]
    assert set(after) < set(before)


def test_near_duplicates_equal_brute_force(stages):
    _, before, after, _ = stages[1]
    groups = brute_groups([(r.doc_id, r.text) for r in before], 5, 80)
    assert {r.doc_id for r in after} == {d for d, (_, c) in groups.items() if c == d}


def test_repeated_passages_equal_brute_force(stages):
    _, before, after, _ = stages[2]
    kept = brute_passages([(r.doc_id, r.text) for r in before], 50)
    assert {r.doc_id: r.text for r in after} == {d: k.decode("utf-8", "ignore") for d, (_, k) in kept.items()}
    assert all(r.n_chars == len(r.text) for r in after)


def test_benchmark_passages_equal_brute_force(spark, stages):
    _, before, after, _ = stages[3]
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after}
    for r in before:
        text = " ".join(re.findall(r"\w+", r.text.lower()))
        if any(item in text for item in items):
            assert r.doc_id not in kept
        elif r.doc_id not in kept:
            assert any(best_distance(item, text) <= len(item) // 10 for item in items)


def test_every_kept_document_is_packed(stages):
    _, before, after, _ = stages[4]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}


def test_registered_with_the_queries(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    numbers = {re.match(r"op(\d+)_", n)[1] for n in entry.queries() if re.match(r"op\d+_", n)}
    assert numbers == {str(n) for n in range(1, 14)}
    assert corpus_pipeline.run(spark, SF).count() > 0
