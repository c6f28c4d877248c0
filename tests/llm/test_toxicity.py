from __future__ import annotations

import random

import numpy as np

from creditloom.llm.toxicity import FEATURES, Boosting, Tokens, entries, fit_toxicity, isotonic, learn_lexicon, plain, toxicity_scores, train, without_toxic
from tests.conftest import SF

BAD = ["nitwit", "blockhead", "dunce", "oaf"]


def labelled(n, seed):
    rng = random.Random(seed)
    texts, toxic = [], []
    for _ in range(n):
        words = [f"word{rng.randint(0, 300)}" for _ in range(rng.randint(5, 80))]
        label = rng.random() < 0.2
        if label:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        texts.append(" ".join(words))
        toxic.append(label)
    return texts, np.array(toxic, float)


def test_held_out_rows_are_told_apart():
    model = train(*labelled(600, 1))
    texts, toxic = labelled(400, 2)
    tokens = Tokens(model.lexicon)
    scores = model.scores(np.array([tokens.features(t) for t in texts]))
    assert ((scores >= 0.5) == toxic).mean() > 0.98
    assert abs(scores.mean() - toxic.mean()) < 0.05


def test_obfuscated_spelling_counts_as_the_word():
    tokens = Tokens({"nitwit$": 5.0})
    plain, hidden = tokens.features("you n1tw1t"), tokens.features("you nitwit")
    names = dict(zip(FEATURES, plain))
    assert names["obfuscated"] == 0.5 and dict(zip(FEATURES, hidden))["obfuscated"] == 0
    assert names["near_second_person"] == 0.5 and names["highest_weight"] == 5.0


def test_features_of_empty_text():
    assert not Tokens({}).features(" \n").any()


def test_lexicon_prefers_what_toxic_rows_have():
    texts, toxic = labelled(500, 3)
    assert {f"{w}$" for w in BAD} <= set(learn_lexicon(texts, toxic))


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3)).astype(float)
    p = 1 / (1 + np.exp(-Boosting().fit(x[:1500], y[:1500]).margin(x[1500:])))
    assert ((p > 0.5) == y[1500:]).mean() > 0.97


def test_isotonic_curve_equals_pooling_by_brute_force():
    rng = np.random.default_rng(1)
    margin = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-margin))).astype(float)
    place, share = isotonic(margin, y)
    assert (np.diff(place) > 0).all() and (np.diff(share) >= 0).all() and 0 < share[0] and share[-1] < 1
    # The least-squares rising fit at i is the largest over starts of the smallest mean over ends.
    s = y[np.argsort(margin)]
    sums = np.append(0, s.cumsum())
    means = lambda a, b: (sums[b + 1] - sums[a]) / (b + 1 - a)
    fit = [max(min(means(a, b) for b in range(i, 300)) for a in range(i + 1)) for i in range(300)]
    assert len(share) - 2 == len(np.unique(np.round(fit, 12)))


def test_documents_with_odd_texts_and_labels(spark, documents_of, odd_texts):
    texts, toxic = labelled(300, 4)
    documents = documents_of(texts + odd_texts)
    labels = spark.createDataFrame(
        [(i, int(t)) for i, t in enumerate(toxic)] + [(None, 1), (3, None), (5, int(toxic[5])), (99999, 1)], "doc_id long, toxic int"
    )
    model = fit_toxicity(documents, labels)
    scores = {r.doc_id: r.score for r in toxicity_scores(documents, model).collect()}
    assert len(scores) == len(texts) + len(odd_texts) and all(0 <= s <= 1 for s in scores.values())
    assert all(scores[len(texts) + i] < 0.5 for i in range(len(odd_texts)))
    kept = without_toxic(documents, model)
    assert {r.doc_id for r in kept.collect()} == {d for d, s in scores.items() if s < 0.5}
    assert kept.columns == documents.columns


def test_no_labels_and_no_documents(spark, documents_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(documents_of(["a text"]), none)
    assert [r.score for r in toxicity_scores(documents_of(["a text", None]), model).collect()] == [0.0, 0.0]
    assert toxicity_scores(documents_of([]), model).count() == 0


def test_query_on_given_tables(spark):
    from creditloom.llm.queries import QUERIES

    rows = QUERIES["op5_toxicity"](spark, SF).collect()
    assert len(rows) == 200 and all(r.predicted == (r.score >= 0.5) for r in rows)


def test_known_tokens_are_rows_of_numbers():
    tokens = Tokens({"badw": 4.0, "fool$": 2.0})
    words = ["badword", "fool", "FOOL!", "f00l", "you", "3.5", "¿qué?", "ǅ", "a" * 30, *[f"w{i}x" for i in range(3000)]]
    tokens.features(" ".join(words))
    assert tokens.facts.nbytes <= 2 * 64 * len(words)  # objects took some 600 bytes a token
    for word in words:
        letters, shown = plain(word)
        weight = max(tokens.lexicon.get(e, 0.0) for e in entries(letters))
        upper, marks = sum(c.isupper() for c in word), sum(not c.isalnum() for c in word)
        held = sum(c.isalpha() for c in word)
        expected = [weight, letters == "you", upper, held > 2 and word.isupper(), word.count("!"), marks - word.count("!"), shown, held]
        assert tokens.facts[tokens[word]].tolist() == expected
