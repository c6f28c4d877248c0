from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from creditloom.llm import packing
from creditloom.llm.packing import difference, pack_rest, packed

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length > 0
    for doc, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        own = sorted(pieces[doc], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == ids
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert {r.doc_tokens for r in own} == {len(ids) // 4}
    used = room = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        total = sum(r.length for r in own)
        assert total <= capacity
        used += total
        room += total if total & (total - 1) == 0 else capacity
    return used / room


def test_every_id_once_and_little_padding(documents_of, odd_texts):
    rng = random.Random(4)
    texts = odd_texts + [" ".join(rng.choice(["alpha", "Beta,", "gamma's", "12", "öl!"]) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    texts += ["<|endoftext|> in a text", "Σίσυφος ΣΑΣ", "é ́x \x1c\x1d y z\x85w", "İstanbul ﬁne K", "don't WE'LL 'S"]
    rows = packed(documents_of(texts), PATH, capacity=128, item_tokens=16, group_windows=16, slack=24).collect()
    assert check_pieces(rows, dict(enumerate(texts)), 128) > 0.97


def test_no_documents(documents_of):
    assert packed(documents_of([]), PATH).count() == 0


def test_words_that_are_forgotten_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
    known, text = packing.WordIds(PATH), "one two three, four one two! five"
    expected = np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert known.of(text) == known.of(text) == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.integers(1, 7))
def test_differencing_deals_every_item_and_beats_a_greedy_deal(sizes, windows):
    parts = difference(sizes, windows)
    assert len(parts) == windows and sorted(i for p in parts for i in p) == list(range(len(sizes)))
    loads = [sum(sizes[i] for i in p) for p in parts]
    assert max(loads) - min(loads) <= max(sizes, default=0)


def test_differencing_of_a_known_case():
    loads = sorted(sum((8, 7, 6, 5, 4)[i] for i in p) for p in difference([8, 7, 6, 5, 4], 2))
    assert loads == [14, 16]


def test_the_rest_needs_no_padding():
    windows = list(pack_rest([(1, 0, b"\0" * 4 * 300, 300), (2, 0, b"\0" * 4 * 77, 77)], 128))
    lengths = [sum(len(p[2]) // 4 for p in w) for w in windows]
    assert lengths == [128, 128, 64, 32, 16, 8, 1]


def test_small_tasks_are_differenced_too(spark):
    """Many tasks of a few windows each: nearly all windows come out of a differencing, and padding stays below a hundredth."""
    from tests.conftest import SF

    documents = spark.read.parquet(f"{SF}/documents.parquet").repartition(19)
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    rows = packed(documents, PATH).collect()
    assert check_pieces(rows, texts, 2048) > 0.99
    total = {}
    for r in rows:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    tasks = {s >> 33 for s in total}
    for task in tasks:
        own = [n for s, n in total.items() if s >> 33 == task]
        powers = [n for n in own if n & (n - 1) == 0]
        assert len(powers) - powers.count(2048) <= 13
        assert min((n for n in own if n & (n - 1)), default=2048) > 2048 - 3 * 48
