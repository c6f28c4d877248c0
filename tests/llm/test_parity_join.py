from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from creditloom.llm import parity_join as pj
from creditloom.llm.components import components
from creditloom.llm.text import mix
from creditloom.sources.intermediate import checkpoint_root


def sets_of(texts, width):
    out = {}
    for doc, text in texts:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        out[doc] = runs or ({tuple(words)} if words else set())
    return out


def brute(texts, width, percent):
    sets = sets_of(texts, width)
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def edited_texts(seed, n=60):
    """Chains of versions, some near, some not; one family is large."""
    rng = random.Random(seed)
    texts = []
    for family in range(6):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([2, 5, 12, 40, 150, 300]))]
        for _ in range(n if family == 5 else 8):
            words = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 1, 80)])
def test_components_equal_brute_force(documents_of, seed, width, percent):
    texts = edited_texts(seed)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in pj.parity_join(documents_of(texts), width, percent).collect()}
    assert found == brute(texts, width, percent)


def test_blocks_of_a_crowded_bucket(documents_of, monkeypatch):
    monkeypatch.setattr(pj, "BLOCK", 3)
    texts = edited_texts(11, 30)
    found = {r.doc_id: r.component_id for r in pj.parity_join(documents_of(texts), 3, 80).collect()}
    assert found == {d: c for d, (_, c) in brute(texts, 3, 80).items()}


@pytest.mark.parametrize("percent", [80, 90])
def test_links_between_documents_whose_buckets_belong_to_dissimilar_ones(documents_of, percent):
    """Frequent lines stand in many smaller, half-alike documents, which lead every bucket of two similar ones."""
    rng = random.Random(5)
    texts, late = [], []
    for family in range(4):
        lines = [[f"l{family}q{i}w{k}" for k in range(3)] for i in range(16)]
        for n in range(150):
            texts.append(" ".join(w for i, line in enumerate(lines) for w in (line if rng.random() < 0.75 else [f"o{family}x{n}y{i}z{k}" for k in range(3)])))
        for n in range(3):
            late.append(" ".join([w for line in lines for w in line][:-1] + [f"end{n}"]))
    texts = list(enumerate(texts + late))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in pj.parity_join(documents_of(texts), 1, percent).collect()}
    assert found == brute(texts, 1, percent)


def test_similarities_do_not_touch_each_other(documents_of):
    """Workers that have served one similarity give the right bands for another."""
    texts = edited_texts(21)
    for percent in (90, 80, 90):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in pj.parity_join(documents_of(texts), 3, percent).collect()}
        assert found == brute(texts, 3, percent)


def test_odd_documents(documents_of, odd_texts):
    texts = list(enumerate(odd_texts))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in pj.parity_join(documents_of(odd_texts)).collect()}
    assert found == brute(texts, 3, 90)
    assert pj.parity_join(documents_of([])).count() == 0
    assert [r.component_id for r in pj.parity_join(documents_of([(None, "a b c d")])).collect()] == [None]


def test_one_document_of_each_group_stays(documents_of):
    text = " ".join(f"w{i}" for i in range(60))
    source = documents_of([(3, text), (1, text + " more"), (1, text + " more"), (7, "another text"), (None, "no id"), (8, None)])
    out = pj.one_of_each_group(source)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 7), (False, 8), (True, 0)]
    assert out.columns == source.columns


def test_sketch_distance_bounds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        one = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        other = np.unique(np.concatenate([one[: rng.integers(1, 200)], rng.integers(0, 2**63, 20).astype(np.uint64)]))
        distance = np.bitwise_count(pj.sketch(one, 7) ^ pj.sketch(other, 7)).sum()
        assert distance <= len(np.setxor1d(one, other))


@pytest.mark.parametrize("percent", [90, 80, 90, 85])
def test_sizes_of_partners_lie_in_neighbouring_bands(percent):
    for a in range(1, 3000):
        for b in {a, -(-a * 100 // percent) - 1, a * 100 // percent}:
            if b >= a and 100 * a >= percent * b:
                assert pj.band_of(b, percent) - pj.band_of(a, percent) in (0, 1)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(51)) and all(found[1000 + i] == 1000 for i in range(300))


@pytest.mark.parametrize("seed", range(3))
def test_blocks_send_each_pair_once_and_without_objects(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    shingles = mix(np.arange(1, 130, dtype=np.uint64))
    sets = [np.unique(rng.choice(shingles[:n], n - 2, replace=False)) for n in rng.integers(40, 130, 60)]
    members = pd.DataFrame({
        "lo": 0, "hi": 0, "part": 0, "doc_id": rng.permutation(60), "component": rng.integers(0, 5, 60), "size": [len(s) for s in sets],
        "sketch": [pj.sketch(s, pj.sketch_words(len(s))).tobytes() for s in sets],
    })
    mixed = members.assign(hi=1, part=np.arange(60) % 2)
    counted = []
    counts = np.bitwise_count
    for block in (members, mixed):
        words = block["sketch"].str.len().min() // 8
        narrow = [pj.folded(np.frombuffer(s, np.uint64), words) for s in block["sketch"]]
        expected = set()
        for i in range(60):
            for j in range(i):
                one, other = block.iloc[i], block.iloc[j]
                limit = (one["size"] + other["size"]) * 20 // 180
                near = abs(one["size"] - other["size"]) <= limit and np.bitwise_count(narrow[i] ^ narrow[j]).sum() <= limit
                if near and one.component != other.component and (block is members or one.part != other.part):
                    expected.add((min(one.doc_id, other.doc_id), max(one.doc_id, other.doc_id)))
        monkeypatch.setattr(np, "bitwise_count", lambda x: counted.append(len(x)) or counts(x))
        found = pj._pairs_of_block(block, 80)
        monkeypatch.setattr(np, "bitwise_count", counts)
        assert expected and sorted(map(tuple, found.to_numpy().tolist())) == sorted(expected)
        # Sizes too far apart are not compared, nor one pair twice.
        assert sum(counted) < (60 * 59 // 2 if block is members else 30 * 30)
        counted.clear()


def test_stored_texts_and_sketches_go_again(documents_of, spark):
    common = " ".join(f"word{i}" for i in range(60))
    root = Path(checkpoint_root(spark))
    before = set(root.iterdir())
    joined = pj.parity_join(documents_of([common, common + " more", "something else entirely"]), 3, 90)
    assert {r.doc_id: r.component_id for r in joined.collect()} == {0: 0, 1: 0, 2: 2}
    kept = {p.name.split("-")[0] for p in set(root.iterdir()) - before}
    assert "similar" in kept and not kept & {"texts", "crowded", "digests", "pairs"}
