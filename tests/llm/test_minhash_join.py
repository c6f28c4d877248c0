from __future__ import annotations

import random
from math import comb

import numpy as np
import pytest

from creditloom.llm import meetings
from creditloom.llm import minhash_join as mj
from tests.llm.test_parity_join import brute, edited_texts


def found(documents, width=5, percent=85):
    rows = mj.minhash_groups(documents, width, percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize(("seed", "width"), [(1, 5), (2, 2)])
def test_components_equal_brute_force(documents_of, seed, width):
    texts = edited_texts(seed)
    assert found(documents_of(texts), width) == brute(texts, width, 85)


def test_members_that_the_smallest_document_does_not_link(documents_of, monkeypatch):
    """Half-alike documents that share frequent lines lead the lists of later, similar ones; small blocks."""
    monkeypatch.setattr(mj, "BLOCK", 4)
    monkeypatch.setattr(mj, "_HELD", 16)
    monkeypatch.setattr(meetings, "MEETING", 2)
    rng = random.Random(5)
    lines = [[f"q{i}w{k}" for k in range(8)] for i in range(12)]
    texts = []
    for n in range(60):
        texts.append(" ".join(w for i, line in enumerate(lines) for w in (line if rng.random() < 0.8 else [f"o{n}i{i}k{k}" for k in range(8)])))
    for n in range(6):
        texts.append(" ".join([w for line in lines for w in line] + [f"end{n}"]))
    texts = list(enumerate(texts))
    assert found(documents_of(texts)) == brute(texts, 5, 85)


def test_odd_documents(documents_of, odd_texts):
    texts = list(enumerate(odd_texts))
    assert found(documents_of(odd_texts)) == brute(texts, 5, 85)
    assert found(documents_of([])) == {}
    rows = mj.minhash_groups(documents_of([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")])).collect()
    assert sorted(((r.doc_id or -1), r.component_id, r.kept) for r in rows) == [(-1, None, True)] * 2 + [(4, 4, True)] * 2


def test_a_text_longer_than_a_slice(documents_of):
    long = " ".join(f"w{i}x{i % 977}" for i in range(250_000))
    texts = [(1, "some other words stand here now"), (2, long), (3, long + " and an end"), (4, long[: len(long) // 2])]
    assert found(documents_of(texts)) == brute(texts, 5, 85)


def test_threshold_bounds_the_missed_pairs():
    for k, percent in ((48, 85), (64, 80), (16, 90)):
        t = mj.least_matches(k, percent)
        below = lambda m: sum(comb(k, i) * (percent / 100) ** i * (1 - percent / 100) ** (k - i) for i in range(m))  # noqa: B023, E731
        assert below(t) <= mj.MISSED < below(t + 1)


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(7)
    agreed = []
    for _ in range(60):
        shared = rng.integers(0, 2**63, 85).astype(np.uint64)
        sides = [np.sort(np.concatenate([shared, rng.integers(0, 2**63, n).astype(np.uint64)])) for n in (8, 7)]
        one, other = (mj.signatures(s, np.array([0, len(s)]), 256)[0] for s in sides)
        agreed.append((one == other).mean())
    assert np.mean(agreed) == pytest.approx(0.85, abs=0.02)


def test_sketches_never_rule_a_similar_pair_out():
    import pyarrow as pa

    from creditloom.llm.parity_join import sketch, sketch_words

    rng = np.random.default_rng(9)
    sets = []
    for n in (1, 2, 7, 40, 255, 256, 511, 512, 700, 3000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for change in (0, 1, n // 12, n // 5, n // 2):
            kept = base[: n - change] if rng.random() < 0.5 else base
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, change).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    sketches = mj._Sketches(pa.array([sketch(s, 2 * sketch_words(len(s))).tobytes() for s in sets], pa.binary()), sizes)
    one, other = np.triu_indices(len(sets), 1)
    near = mj._size_reaches(sizes[one], sizes[other], 85)
    one, other = one[near], other[near]
    shared = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(one, other)])
    similar = 100 * shared >= 85 * (sizes[one] + sizes[other] - shared)
    allowed = sketches.allow(one, other, 85)
    assert similar.any() and (allowed | ~similar).all() and not allowed[shared < 0.6 * sizes[one]].any()
