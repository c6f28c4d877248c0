from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from creditloom.llm import decontamination as dc


def best_distance(pattern, text):
    """Sellers' algorithm: the smallest edit distance of the pattern to any substring."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        previous, row = row, [i] + [0] * len(text)
        for j, c in enumerate(text, 1):
            row[j] = min(previous[j] + 1, row[j - 1] + 1, previous[j - 1] + (p != c))
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=60), st.integers(0, 20))
def test_bit_parallel_distance(pattern, text, limit):
    found, expected = dc.nearest(pattern, text, limit), best_distance(pattern, text)
    assert (found is None) == (expected > limit or (not text))
    if found:
        assert found[0] == expected and best_distance(pattern, text[: found[1]]) == expected


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=20, max_size=60), st.text("ab ", max_size=120), st.sampled_from([5, 10, 20]))
def test_matches_exactly_the_texts_within_the_budget(item, text, percent):
    item, text = dc.normalised(item), dc.normalised(text)
    if not item:
        return
    found = list(dc.Matcher([(0, item)], percent).find(text))
    budget = len(item) * percent // 100
    assert bool(found) == (best_distance(item, text) <= budget)
    for _, start, end, distance in found:
        assert best_distance(item, text[start:end]) == distance <= budget


def edit(text, n, rng):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], ["q"], [out[at], "q"]])
    return "".join(out)


def test_planted_passages(spark, documents_of, odd_texts, monkeypatch):
    rng = random.Random(1)
    words = ["river", "stone", "cloud", "seven", "window", "paper", "orange", "delta"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    items = [prose(25) for _ in range(7)]
    planted = {i: edit(item, len(item) // 20, rng) for i, item in enumerate(items)}
    texts = list(odd_texts) + [f"{prose(30)}. {planted[i % 7].upper()}\n{prose(30)}" for i in range(14)]
    table = spark.createDataFrame([*enumerate(items), (50, None), (51, " .. "), (None, items[0])], "item_id long, text string")
    monkeypatch.setattr(dc, "ITEMS_PER_BLOCK", 4)
    rows = dc.contaminations(documents_of(texts), table, 10).collect()
    expected = {(len(odd_texts) + i, i % 7) for i in range(14)} | {(len(odd_texts) + i, None) for i in (0, 7)}
    assert {(r.doc_id, r.item_id) for r in rows} == expected
    for r in rows:
        passage = dc.normalised(texts[r.doc_id][r.start : r.end])
        assert abs(len(passage) - len(items[r.item_id or 0])) < 40
    kept = dc.without_contaminated(documents_of(texts), table, 10)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(odd_texts)))


def test_empty_tables(spark, documents_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminations(documents_of(["some text"]), none).count() == 0
    assert dc.without_contaminated(documents_of(["some text"]), none).count() == 1
    one = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert dc.contaminations(documents_of([]), one).count() == 0
