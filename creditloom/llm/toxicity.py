"""Toxicity scores: boosted trees over dense features of a text, with isotonic calibration.

The features are rates and densities: words of a learned lexicon (how dense, how many, how strong, how near to a word of
the second person), capitals, punctuation, obfuscated spellings and length. The lexicon holds whole words and word stems
that toxic rows have much more often than others; an obfuscated spelling (d1gits or s*gns for letters) is looked up as
the letters it stands for.

Everything is fitted on a bounded sample of labelled rows, the ``max_rows`` with the smallest hashes of their ids. A
lexicon makes the rows that it was learned from look too easy, so the trees learn from features that lexicons of the
other folds gave, and the calibration learns from scores that trees of the other folds gave.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "strong_density", "strong_words", "strong_kinds", "weak_density", "highest_weight", "three_highest", "near_second_person",
    "second_person", "capitals", "shouted_words", "exclamations", "other_punctuation", "obfuscated", "words",
)
FOLDS = 3
STRONG, WEAK = 3.0, 1.5
LEXICON_SIZE = 4000
KNOWN_TOKENS = 300_000
# Documents that the pipeline's stage hands on at once.
LOT = 512
# Words that address the reader, and the letters that digits and signs stand for.
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes".split()
)
LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})


def entries(word: str) -> set[str]:
    """The lexicon entries that a word can meet: itself, and its stems of 4 to 7 letters."""
    return {word + "$"} | {word[:n] for n in range(4, 8) if len(word) > n}


def plain(token: str) -> tuple[str, bool]:
    """A token's letters in lower case, and whether signs or digits stood among them."""
    core = token.strip(".,;:!?\"'()[]|&%#*<>-_").lower()
    if core.isalpha() or not any(map(str.isalpha, core)):
        return core, False
    inner = core.translate(LETTERS)
    return inner, inner.isalpha() and len(inner) > 2


class Tokens(dict):
    """Numbers of tokens, with what is known about each: its lexicon weight and its marks."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon
        # A row for each token: numbers take far less room there than as objects.
        self.facts = np.zeros((1024, 8))

    def weight(self, word: str) -> float:
        """The highest weight of the word's ``entries``."""
        get, size = self.lexicon.get, len(word)
        best = get(word + "$", 0.0)
        for n in range(4, min(size, 8)):
            best = max(best, get(word[:n], 0.0))
        return best

    def __missing__(self, token: str) -> int:
        word, hidden = plain(token)
        if token.isalpha():
            letters, exclamations, others = len(token), 0, 0
        else:
            letters, exclamations = sum(map(str.isalpha, token)), token.count("!")
            others = len(token) - sum(map(str.isalnum, token)) - exclamations
        upper = 0 if token.islower() else sum(map(str.isupper, token))
        number = len(self)
        if number == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        self.facts[number] = (
            self.weight(word), word in SECOND_PERSON, upper, letters > 2 and token.isupper(), exclamations, others, hidden, letters
        )
        self[token] = number
        return number

    def features(self, text: str) -> np.ndarray:
        """The dense features of one text; an empty text has zeros."""
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        tokens = text.split()
        if not tokens:
            return np.zeros(len(FEATURES))
        numbers = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        kinds, counts = np.unique(numbers, return_counts=True)
        facts = self.facts[kinds]
        sums = counts @ facts
        weight = facts[:, 0]
        strong = weight >= STRONG
        n, letters = len(tokens), max(sums[7], 1.0)
        near = 0.0
        if strong.any() and sums[1]:
            second = np.flatnonzero(self.facts[numbers, 1])
            places = np.flatnonzero(self.facts[numbers, 0] >= STRONG)
            after = np.searchsorted(second, places)
            gaps = np.minimum(
                np.abs(places - second[np.minimum(after, len(second) - 1)]), np.abs(places - second[np.maximum(after - 1, 0)])
            )
            near = 1.0 / (1.0 + gaps.min())
        highest = np.sort(weight)[::-1][:3]
        return np.array([
            counts[strong].sum() / n, np.log1p(counts[strong].sum()), np.log1p(strong.sum()), counts[weight >= WEAK].sum() / n,
            highest[0], highest.sum(), near, sums[1] / n, sums[2] / letters, sums[3] / n, sums[4] / n, sums[5] / n, sums[6] / n,
            np.log1p(n),
        ])


def learn_lexicon(texts: Sequence[str], toxic: np.ndarray) -> dict[str, float]:
    """Entries by log odds of a row with the entry to be toxic, the best supported ones."""
    found = (Counter(), Counter())
    for text, label in zip(texts, toxic):
        words = {plain(t)[0] for t in set(text.split())}
        found[int(label)].update(set().union(*map(entries, words)) if words else ())
    n = np.bincount(toxic.astype(np.int64), minlength=2)
    scored = []
    for entry, hits in found[1].items():
        if hits >= 3:
            weight = np.log((hits + 0.5) / (n[1] + 1)) - np.log((found[0][entry] + 0.5) / (n[0] + 1))
            if weight >= WEAK:
                scored.append((weight * hits, entry, weight))
    return {entry: float(weight) for _, entry, weight in sorted(scored, reverse=True)[:LEXICON_SIZE]}


@dataclass
class Boosting:
    """Boosted trees for a binary label: logistic loss, Newton leaves, splits at histogram bins."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    penalty: float = 1.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, edges, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += self._leaf_values(tree, x)
        return self

    def _grow(self, binned: np.ndarray, edges: list, gradient: np.ndarray, hessian: np.ndarray):
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(gradient), np.int64)  # place in the current level
        for level in range(self.depth):
            width, first = 1 << level, (1 << level) - 1
            gain = np.full(width, 1e-9)
            chosen = np.full(width, -1)
            bin_of = np.zeros(width, np.int64)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                slots = node * (len(e) + 1) + binned[:, f]
                g, h = (np.bincount(slots, v, width * (len(e) + 1)).reshape(width, -1) for v in (gradient, hessian))
                left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                total_g, total_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                score = lambda a, b: a * a / (b + self.penalty)
                gains = score(left_g, left_h) + score(total_g - left_g, total_h - left_h) - score(total_g, total_h)
                best = gains.argmax(1)
                better = gains[np.arange(width), best] > gain
                gain = np.where(better, gains[np.arange(width), best], gain)
                chosen, bin_of = np.where(better, f, chosen), np.where(better, best, bin_of)
            for i in np.flatnonzero(chosen >= 0):
                feature[first + i], cut[first + i] = chosen[i], edges[chosen[i]][bin_of[i]]
            right = (chosen[node] >= 0) & (binned[np.arange(len(node)), np.maximum(chosen[node], 0)] > bin_of[node])
            node = node * 2 + right
        leaves = 1 << self.depth
        values = np.bincount(node, gradient, leaves) / (np.bincount(node, hessian, leaves) + self.penalty)
        return feature, cut, self.rate * values

    def _leaf_values(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        feature, cut, values = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        return values[node - ((1 << self.depth) - 1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._leaf_values(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising curve from margins to shares of label 1: pooled neighbours, each at its mean margin."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, label in zip(margin[order], y[order]):
        pools.append([float(label), 1.0, float(m)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    # Half a row of either label keeps the ends off 0 and 1, so that scores beyond them can still rise.
    share = np.maximum.accumulate([(p[0] + 0.5) / (p[1] + 1) for p in pools])
    place = np.array([p[2] / p[1] for p in pools])
    low, high = place[0] - 5, place[-1] + 5
    return np.concatenate([[low], place, [high]]), np.concatenate([[share[0] / 2], share, [(1 + share[-1]) / 2]])


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Boosting | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float = 0.0

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(features), self.share)
        return np.interp(self.trees.margin(features), *self.knots)


def train(texts: Sequence[str], toxic: np.ndarray) -> ToxicityModel:
    """The model of labelled texts in a random order; with one label only, every score is that label's share."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if len(toxic) < 4 * FOLDS or min(toxic.sum(), len(toxic) - toxic.sum()) < FOLDS:
        return ToxicityModel({}, None, None, share)
    fold = np.arange(len(texts)) % FOLDS
    features = np.zeros((len(texts), len(FEATURES)))
    for k in range(FOLDS):
        others = np.flatnonzero(fold != k)
        tokens = Tokens(learn_lexicon([texts[i] for i in others], toxic[others]))
        for i in np.flatnonzero(fold == k):
            features[i] = tokens.features(texts[i])
    margins = np.zeros(len(texts))
    for k in range(FOLDS):
        others = fold != k
        margins[fold == k] = Boosting().fit(features[others], toxic[others]).margin(features[fold == k])
    return ToxicityModel(
        learn_lexicon(texts, toxic), Boosting().fit(features, toxic), isotonic(margins, toxic), share
    )


def labelled_sample(documents: DataFrame, labels: DataFrame, max_rows: int) -> tuple[list[str], np.ndarray]:
    """The texts and labels of at most ``max_rows`` labelled rows, those with the smallest hashes of their ids."""
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(max_rows)
    )
    # At most max_rows ids and labels.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null").toPandas()
    rows = rows.sort_values("doc_id", key=lambda ids: (ids * 2654435761) % (1 << 32), kind="stable")
    return rows.text.tolist(), (rows.toxic.to_numpy() > 0).astype(np.float64)


def fit_toxicity(documents: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> ToxicityModel:
    return train(*labelled_sample(documents, labels, max_rows))


def toxicity_scores(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per row: doc_id and score (0 to 1). Null and empty texts are scored by their features, which are zero.

    Repeated rows get equal scores; an empty table gives no rows. Columns besides doc_id and text are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a lexicon and trees of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value.lexicon)
        for batch in batches:
            features = np.array([tokens.features(t.as_py() or "") for t in batch.column("text")])
            scores = shared.value.scores(features.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(score, "doc_id long, score double")


def without_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score lies below ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value.lexicon)
        for batch in batches:
            # Whole texts go on in lots, so that few are held twice.
            for part in (batch.slice(at, LOT) for at in range(0, batch.num_rows, LOT)):
                features = np.array([tokens.features(t.as_py() or "") for t in part.column("text")])
                scores = shared.value.scores(features.reshape(-1, len(FEATURES)))
                yield part.filter(pa.array(scores < threshold))

    return documents.mapInArrow(keep, documents.schema)
