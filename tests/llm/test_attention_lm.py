from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from creditloom.llm import attention_lm as lm

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def corpus(n, seed):
    """Two languages of invented words, each with words that follow one another."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        language = rng.choice([["river", "stone", "cloud", "seven"], ["maison", "fleuve", "pierre", "nuage"]])
        out.append(" ".join(language[(i + rng.randint(0, 1)) % 4] for i in range(rng.randint(20, 90))))
    return out


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = lm.Attention(7, np.arange(12), width=8, heads=2, hidden=5, length=6)
    model.p = {n: v.astype(np.float64) for n, v in model.p.items()}
    model.p["places"] += rng.normal(size=model.p["places"].shape)
    ids, wanted = rng.integers(0, 13, (3, 6)), rng.random((3, 6)) < 0.7
    targets = rng.integers(0, 7, wanted.sum())
    _, gradients = model.gradients(ids, wanted, targets)
    for name, values in model.p.items():
        for at in rng.integers(0, values.size, 6):
            at = np.unravel_index(at, values.shape)
            kept = values[at]
            values[at] = kept + 1e-5
            above = model.gradients(ids, wanted, targets)[0]
            values[at] = kept - 1e-5
            below = model.gradients(ids, wanted, targets)[0]
            values[at] = kept
            assert gradients[name][at] == pytest.approx((above - below) / 2e-5, abs=1e-4)


def test_fast_scores_are_those_of_training_and_causal():
    rng = np.random.default_rng(1)
    model = lm.Attention(9, np.arange(40), length=16)
    ids, wanted = rng.integers(0, 41, (4, 16)), np.ones((4, 16), bool)
    targets = rng.integers(0, 9, 64)
    fast = model.log_probabilities(ids, wanted, targets)
    assert -fast.mean() == pytest.approx(model.gradients(ids, wanted, targets)[0], abs=1e-4)
    changed = ids.copy()
    changed[:, 10:] = (changed[:, 10:] + 3) % 41
    same = model.log_probabilities(changed, wanted, targets).reshape(4, 16)[:, :10]
    assert np.allclose(same, fast.reshape(4, 16)[:, :10], atol=1e-5)


def test_windows_score_every_place_once():
    lengths = np.array([1, 5, 32, 33, 56, 57, 200])
    places, wanted = lm.window_places(lengths, 32, 24)
    assert sorted(places[wanted].tolist()) == list(range(lengths.sum()))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    assert all(len(set(owner[row])) == 1 for row in places)
    # Later windows bring context along.
    later = ~wanted[:, 0]
    assert later.any() and wanted[later][:, :8].sum() == 0


def test_later_windows_bring_context():
    attention = lm.Attention(7, np.arange(3))
    _, wanted = lm.window_places(np.array([500]), attention.length, lm.LanguageModel.stride)
    assert attention.length >= 48 and (~wanted[1:-1, :16]).all()


def test_sample_holds_distinct_texts(documents_of):
    texts = corpus(30, 4)
    training = documents_of([t for t in texts for _ in range(40)] + [texts[0].upper(), None])
    sample = lm._sample(training, 25)
    assert len({tuple(words) for words in sample}) == len(sample) >= 24
    assert lm._sample(documents_of([None]), 5) == []


def test_window_budget_is_spread_over_all_texts():
    windows = np.array([10_000, 3, 0, 50, 1, 700])
    used = lm._spread(windows, 90)
    of_text = np.bincount(np.repeat(np.arange(6), windows)[used], minlength=6)
    assert of_text.sum() == 90 and of_text[[1, 2, 4]].tolist() == [3, 0, 1] and of_text[[0, 3, 5]].min() >= 28
    assert np.flatnonzero(used[:10_000]).max() > 9_000
    assert lm._spread(windows, 20_000).all()


def test_long_text_leaves_room_and_the_sample_grows(documents_of, monkeypatch):
    seen = []
    train = lm.Attention.train
    monkeypatch.setattr(lm.Attention, "train", lambda self, windows, *rest: seen.append((len(windows), rest[-1])) or train(self, windows, *rest))
    training = documents_of(corpus(60, 5) + ["river stone " * 20_000])
    words = lm.word_counts(training).cache()
    for small in (lm.SMALL_CORPUS, 2_000):
        monkeypatch.setattr(lm, "SMALL_CORPUS", small)
        lm.fit_language_model(training, words, PATH, sample_texts=20, sample_ids=3_200, steps=3, own_classes=12, groups=4)
    assert seen[1][0] > seen[0][0] and seen[1][1] > seen[0][1] == 3


def test_mixture_does_not_depend_on_the_head(documents_of):
    training = documents_of(corpus(60, 6))
    words = lm.word_counts(training).cache()
    fit = lambda n: lm.fit_language_model(training, words, PATH, steps=20, own_classes=12, groups=4, head_words=n)
    assert fit(2).mixture == pytest.approx(fit(1000).mixture, abs=1e-9)


def test_class_shares_and_class_scores_are_distributions():
    model = lm.Attention(11, np.arange(20), length=8)
    ids = np.array([[3, 1, 4, 1, 5, 9, 2, 6]])
    total = sum(np.exp(model.log_probabilities(ids, np.ones((1, 8), bool), np.full(8, c))) for c in range(11))
    assert np.allclose(total, 1, atol=1e-5)
    counts = np.zeros(lm.N_IDS)
    counts[:50] = np.arange(50)
    class_of = lm._classes(counts, np.arange(30), 8, 4)
    assert class_of.min() == 0 and class_of.max() == 11 and len(set(class_of[np.argsort(-counts, kind="stable")[:8]])) == 8


def base_scores(texts, training):
    counts = Counter(w for t in training for w in lm.words_of(t) + [None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, text in enumerate(texts):
        words = lm.words_of(text) + [None]
        score = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out[i] = (len(words), sum(counts[w] > 0 for w in words), n, score)
    return out


@pytest.mark.parametrize("head_words", [300_000, 3])
def test_base_scores_and_gain_over_them(documents_of, odd_texts, head_words):
    texts = corpus(400, 1) + odd_texts
    documents = documents_of(texts)
    training = documents.filter(F.col("doc_id") % 5 != 1)
    words = lm.word_counts(training).cache()
    model = lm.fit_language_model(training, words, PATH, steps=120, own_classes=24, groups=8, head_words=head_words)
    rows = lm.language_scores(documents, model, words, PATH).collect()
    expected = base_scores(texts, [t for i, t in enumerate(texts) if i % 5 != 1])
    assert len(rows) == len(texts)
    for r in rows:
        n_tokens, n_known, train_tokens, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, train_tokens)
        assert r.base_score == pytest.approx(score, abs=1e-6)
        assert r.score <= 0
    held_out = [r for r in rows if r.doc_id % 5 == 1 and r.doc_id < 400]
    assert sum(r.score for r in held_out) > 0.8 * sum(r.base_score for r in held_out)


def test_scores_do_not_depend_on_the_head(documents_of):
    documents = documents_of(corpus(60, 2))
    words = lm.word_counts(documents).cache()
    scores = []
    for head_words in (1000, 2):
        model = lm.fit_language_model(documents, words, PATH, steps=20, own_classes=12, groups=4, head_words=head_words)
        model.mixture = 0.6
        scores.append({r.doc_id: r.score for r in lm.language_scores(documents, model, words, PATH).collect()})
    assert all(scores[0][d] == pytest.approx(scores[1][d], abs=1e-6) for d in scores[0])


def test_no_training_texts_and_no_documents(documents_of):
    documents = documents_of(["one two", None])
    rows = lm.score_with_training(documents, documents.filter("false"), PATH).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.base_score) for r in rows} == {0: (3, 0, 0.0), 1: (1, 0, 0.0)}
    assert lm.score_with_training(documents.filter("false"), documents, PATH).count() == 0


def test_all_training_texts_are_learned(documents_of):
    texts = corpus(200, 7)
    # Words that only texts outside the sample hold follow one another without a choice.
    late = ["maison stone " * 30] * 100
    documents = documents_of(texts + late)
    words = lm.word_counts(documents).cache()
    sample = lm._sample(documents, 5)
    assert lm.words_of(late[0]) not in sample
    small = dict(sample_texts=5, sample_ids=1_000, steps=30, own_classes=24, groups=8)
    unlearned = lm.fit_language_model(documents_of(texts), words, PATH, **small)
    model = lm.fit_language_model(documents, words, PATH, **small)
    table = lm.WordTable(lm.encoder(PATH), model.head)
    new = [lm.words_of(late[0])]
    assert lm.word_scores(model, table, new)[0].sum() > lm.word_scores(unlearned, table, new)[0].sum() + 5


def test_classes_come_from_all_training_texts(documents_of):
    texts = corpus(40, 8) + ["alpha beta gamma delta"]
    documents = documents_of(texts)
    words = lm.word_counts(documents).cache()
    counts = lm._id_counts(words, PATH)
    table = lm.WordTable(lm.encoder(PATH), {})
    ids = table.encode([lm.words_of(t) for t in texts])[2]
    found = lm._all_classes(documents.coalesce(1), counts, PATH, 4, 6)
    assert found.tolist() == lm._classes(counts, ids, 4, 6).tolist()
    rare = table.encode([["alpha"]])[2][0]
    model = lm.fit_language_model(documents, words, PATH, sample_texts=2, steps=2, own_classes=4, groups=6)
    assert model.attention.row_of[rare] < len(model.attention.p["ids"]) - 1


def test_fits_are_alike(documents_of):
    texts = corpus(60, 9)
    documents = documents_of(texts)
    words = lm.word_counts(documents).cache()
    fit = lambda n: lm.fit_language_model(documents.coalesce(n), words, PATH, steps=5, own_classes=12, groups=4)
    one, same = fit(1), fit(1)
    assert all(np.array_equal(one.attention.p[n], same.attention.p[n]) for n in one.attention.p)
    assert one.mixture == same.mixture and 0.02 <= one.mixture <= 0.98


def test_scores_far_below_are_probabilities():
    model = lm.Attention(9, np.arange(40), length=16)
    ids, wanted, targets = np.arange(16)[None], np.ones((1, 16), bool), np.arange(16) % 9
    usual = model.log_probabilities(ids, wanted, targets)
    model.p["bias"] -= 200
    assert np.allclose(model.log_probabilities(ids, wanted, targets), usual, atol=1e-3)
    assert np.allclose(model._backward(ids, wanted, targets)[0], usual, atol=1e-3)


def test_stored_ids_are_those_of_the_texts(documents_of, odd_texts):
    texts = corpus(20, 10) + odd_texts + ["no　break no break", "a ﻿ b", "A\x1cB"]
    head = {"river": 5, "the": 3, lm.END_WORD: 2}
    stored = lm._encode(documents_of(texts).select("doc_id", "text"), PATH, head).toArrow().combine_chunks().to_batches()[0]
    table, begins = lm.WordTable(lm.encoder(PATH), head), lm._word_begins(lm.encoder(PATH))
    loose, seen = stored.column("loose").to_pylist(), []
    for lot in lm._lots(stored, begins):
        docs = stored.column("doc_id").to_pylist()[lot.first : lot.first + len(lot.lengths)]
        words = [lm.words_of(texts[d]) for d in docs]
        numbers, per_text, ids, sizes = table.encode(words)
        assert lot.ids.tolist() == ids.tolist() and lot.sizes.tolist() == sizes.tolist() and lot.per_text.tolist() == per_text.tolist()
        assert [list(head.get(w, -1) for w in (*some, lm.END_WORD)) for some in words] == [
            [head[list(head)[p]] if p >= 0 else -1 for p in part] for part in np.split(lot.places, np.cumsum(per_text)[:-1])
        ]
        assert loose[lot.first : lot.first + len(docs)] == [[w for w in some if w not in head] for some in words]
        seen += docs
    assert sorted(seen) == list(range(len(texts)))


def test_training_rows_as_a_condition_or_as_a_table(documents_of):
    documents = documents_of(corpus(40, 11))
    learned = F.when(F.col("doc_id") != 7, F.col("doc_id") % 5 != 1)
    results = []
    for training in (learned, documents.filter(learned)):
        rows = lm.score_with_training(documents, training, PATH).collect()
        results.append({r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows})
        assert all(r.score <= 0 for r in rows)
    assert results[0] == results[1] and len(results[0]) == 40


def test_room_that_is_used_again_changes_nothing():
    rng = np.random.default_rng(4)
    used = lm.Attention(9, np.arange(40), length=16)
    for b, n in ((5, 16), (2, 16), (3, 7), (5, 16)):
        fresh = lm.Attention(9, np.arange(40), length=16)
        ids, wanted = rng.integers(0, 41, (b, n)), rng.random((b, n)) < 0.8
        targets = rng.integers(0, 9, wanted.sum())
        assert np.array_equal(used.log_probabilities(ids, wanted, targets), fresh.log_probabilities(ids, wanted, targets))
        for mine, other in zip(used.gradients(ids, wanted, targets)[1].values(), fresh.gradients(ids, wanted, targets)[1].values()):
            assert np.array_equal(mine, other)
    assert used.spaces and not used.__getstate__()["spaces"] and not used.copy().spaces
