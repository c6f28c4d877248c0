from __future__ import annotations

import random

import numpy as np
import pytest

from creditloom.llm.suffix_dedup import Suffixes, deduplicated, runs_of, suffix_dedup
from creditloom.llm.text import PrefixHash


def brute(documents, length):
    seen, out = set(), {}
    for doc, text in sorted((d, t or "") for d, t in documents):
        raw = text.encode()
        strings = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        covered = bytearray(len(raw))
        for i, s in enumerate(strings):
            if s in seen:
                covered[i : i + length] = b"\1" * length
        seen.update(strings)
        out[doc] = bytes(covered), bytes(b for b, c in zip(raw, covered) if not c)
    return out


def shared_texts(seed):
    rng = random.Random(seed)
    letters = "ab " if seed % 2 else "abcdefgh ij"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(45, 120))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(60)) for _ in range(5)]
        texts.append("".join(parts))
    return texts + texts[:5]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_bytes_equal_brute_force(documents_of, seed):
    texts = list(enumerate(shared_texts(seed)))
    expected = brute(texts, 50)
    for row in suffix_dedup(documents_of(texts), 50).collect():
        covered, kept = expected[row.doc_id]
        assert bytes(row.kept) == kept
        assert row.n_removed == sum(covered)
        spans = [i for i in range(len(covered)) if covered[i] and (i == 0 or not covered[i - 1])]
        assert row.starts == spans


def test_odd_documents(documents_of, odd_texts):
    expected = brute(list(enumerate(odd_texts)), 50)
    rows = suffix_dedup(documents_of(odd_texts), 50).collect()
    assert {r.doc_id: bytes(r.kept) for r in rows} == {d: kept for d, (_, kept) in expected.items()}


def test_missing_ids_and_empty_table(documents_of):
    text = "a passage that is certainly longer than fifty bytes, as it has to be here"
    rows = suffix_dedup(documents_of([(None, text), (4, text), (9, text)]), 50).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in rows) == [
        (False, 4, 0), (False, 9, len(text)), (True, 0, 0),
    ]
    assert suffix_dedup(documents_of([]), 50).count() == 0


def test_columns_stay_and_characters_stay_whole(documents_of):
    shared = "é" * 40
    source = documents_of([(1, shared), (2, "start " + shared + "ö end")])
    out = {r.doc_id: r for r in deduplicated(source).collect()}
    assert deduplicated(source).columns == source.columns
    # The first byte of ö continues the passage, so it goes, and what is left of ö with it.
    assert out[2].text == "start  end" and out[2].n_chars == len("start  end") and out[2].key == "k"


def test_sort_by_prefix_hashes_is_lexicographic():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3950, 700)
    groups = np.sort(rng.integers(0, 9, 700))
    order = Suffixes(data, 50).sort(starts, groups)
    found = [(groups[i], data[starts[i] : starts[i] + 50].tobytes()) for i in order]
    assert found == sorted(found)


class WeakHash(PrefixHash):
    """Hashes that collide for every pair of strings of one length."""

    def ranges(self, starts, ends):
        return (ends - starts).astype(np.uint64)


def test_collisions_are_found():
    data = np.frombuffer(b"abcdefgh" * 4 + b"abcdefgz" * 4, np.uint8)
    starts = np.array([0, 8, 1, 32, 40])
    classes = Suffixes(data, 8, WeakHash(data)).classes(starts, np.zeros(5, np.int64))
    assert classes[0] == classes[1] != classes[2] and classes[3] == classes[4] != classes[0]


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 90).astype(np.uint8)
    data = np.concatenate([rng.integers(97, 123, 70).astype(np.uint8), passage, rng.integers(97, 123, 33).astype(np.uint8), passage])
    _, begin, end, key, _ = runs_of(data, np.array([0, len(data)]), 50)
    anchor = {}
    for b, e, k in zip(begin, end, key):
        for s in range(b, e - 49):
            anchor[s] = k
    assert all(anchor[70 + i] == anchor[193 + i] for i in range(41))
