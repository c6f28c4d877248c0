"""Language-model scores by a small causal self-attention model on subword ids.

A text is its words (lower-cased A-Z, between ASCII white space), each encoded with a blank before it, and an end. So ids
tell words apart, and a text's probability is the product of its ids' probabilities. An id's probability is that of its
class given the ids before it, from the attention model, times that of the id in its class. Frequent ids are classes of
their own; the others are grouped by the neighbours they have.

All training texts count. Spark jobs form the counts of every training word and, through the words, of every subword id;
they give the probabilities inside classes and the word frequencies. Then every text is encoded once and stored as ids; all
later passes read these. One job counts the neighbours by which ids are grouped. The attention model starts from weights that a sample of distinct texts gives; from there every task takes the
windows of all its training texts, each id once, and the tasks' weights are averaged by the number of their ids. A word's
probability is a mixture of the attention model's and its frequency. The share is fitted on all training words, each with
the probability it had just before its window was learned.

Texts are scored in windows that overlap: each window brings context from the one before, every id is scored once, and
many windows go through the masked attention together. The most frequent words' counts are broadcast (``head_words`` of
them at most). Other words leave the scan with their attention probability and meet their counts in a join.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.sources.intermediate import materialise, release

END_ID = 50256
N_IDS = 50257
# The end of a text in the table of word counts; no word holds white space.
END_WORD = "\n"
KNOWN_WORDS = 300_000
HEAD_WORDS = 100_000
# Windows that are scored at a time, so that their scores stay in a core's cache, and queries of one lot of keys.
LOT = 64
QUERIES = 16
# Training tokens up to which the sample has its smallest size; above, it grows with their square root.
SMALL_CORPUS = 20_000_000
# Words of the texts that are encoded at a time, windows of a step, and the first rate of the pass over all texts.
LOT_WORDS = 50_000
BATCH = 64
RATE = 0.003
# Ids whose rows travel together, and steps of a histogram of log probabilities for a factor of e.
BLOCK = 256
FINE = 64
_LN10 = float(np.log(10.0))


def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().lower().split()]


def _in_range(sums: np.ndarray) -> bool:
    """Whether sums of exponentials have kept their digits, and products with them as well."""
    return bool(((sums > 1e-30) & (sums < 1e30)).all())


class Attention:
    """One layer of causal self-attention and a position-wise layer over subword ids, with class scores on top."""

    def __init__(
        self, classes: int, known_ids: np.ndarray, width: int = 16, heads: int = 2, hidden: int = 32, length: int = 48, seed: int = 1
    ) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.heads, self.length, self.width = heads, length, width
        # Ids that the sample does not show share the last row of the table.
        self.row_of = np.full(N_IDS, len(known_ids), np.int32)
        self.row_of[known_ids] = np.arange(len(known_ids))
        self.mask = np.triu(np.full((length, length), -1e9, np.float32), 1)
        self.spaces: dict[str, np.ndarray] = {}
        self.p = {
            "ids": 0.3 * rng.standard_normal((len(known_ids) + 1, width)).astype(np.float32),
            "places": np.zeros((length, width), np.float32),
            "query": draw(width, width), "key": draw(width, width), "value": draw(width, width), "out": draw(width, width),
            "up": draw(width, hidden), "up_bias": np.zeros(hidden, np.float32), "down": draw(hidden, width),
            "classes": draw(width, classes), "bias": np.zeros(classes, np.float32),
        }

    def __getstate__(self) -> dict:
        return self.__dict__ | {"spaces": {}}

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """Room for an intermediate result, the same for one batch after another: fresh pages cost more than the sums in them."""
        size, kind = int(np.prod(shape)), self.p["ids"].dtype
        held = self.spaces.get(name)
        if held is None or held.size < size or held.dtype != kind:
            held = self.spaces[name] = np.empty(size, kind)
        return held[:size].reshape(shape)

    def _product(self, name: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.matmul(left, right, out=self._space(name, *left.shape[:-1], right.shape[-1]))

    def _rows(self, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        # All of them exist; "clip" lets them go straight to their place.
        return table.take(at, axis=0, out=self._space(name, len(at), table.shape[1]), mode="clip")

    def log_probabilities(self, ids: np.ndarray, wanted: np.ndarray, targets: np.ndarray, start: int = 0, careful: bool = False) -> np.ndarray:
        """Log probability (natural) of the target class at every wanted place of the windows, none of them before ``start``.

        Queries are taken ``QUERIES`` at a time, each lot with the keys up to its last place, so little of what the mask hides
        is worked out. Scores stay far from where exp leaves its range; should one get there all the same, the largest of each row
        is taken off first (``careful``).
        """
        p, (b, n), d = self.p, ids.shape, self.width
        x, q, k, v = self._inputs(self.row_of.take(ids.ravel()), n)
        mixed = self._space("mixed", b, n - start, self.heads, d // self.heads + 1)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for first, last, a in self._weights(q, k, start, careful):
                np.matmul(a, v[:, :, :last], out=mixed.transpose(0, 2, 1, 3)[:, :, first - start : last - start])
            o = np.divide(mixed[..., :-1], mixed[..., -1:], out=self._space("o", *mixed.shape[:-1], d // self.heads)).reshape(-1, d)
        y = self._rows("rows", x, np.flatnonzero(wanted))
        y[:, :d] += self._rows("out", o, np.flatnonzero(wanted[:, start:])) @ p["out"]
        act = self._product("act", y, np.vstack([p["up"], p["up_bias"]]))
        np.maximum(act, 0, out=act)
        y[:, :d] += act @ p["down"]
        z = self._product("z", y, np.vstack([p["classes"], p["bias"]]))
        if careful:
            z -= z.max(axis=1, keepdims=True)
        picked = z[np.arange(len(z)), targets].astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            sums = np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype)
            out = picked - np.log(sums)
        if careful or (np.isfinite(out).all() and _in_range(sums)):
            return out
        return self.log_probabilities(ids, wanted, targets, start, True)

    def _inputs(self, rows: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Inputs by place, with a one as the last of them, and queries, keys and values by window and head.

        The one makes biases a row of a product, and the last of a head's values, so that sums of weights come out of the
        product with the values.
        """
        p, d, h = self.p, self.width, self.heads
        x = self._space("x", len(rows), d + 1)
        x[:, :d], x[:, d] = self._rows("ids", p["ids"], rows), 1
        x.reshape(-1, n, d + 1)[..., :d] += p["places"][:n]
        into = np.zeros((d + 1, 3 * d + h), x.dtype)
        into[:d, : 2 * d] = np.concatenate([p["query"] * np.float32(1 / np.sqrt(d // h)), p["key"]], axis=1)
        into[:d, 2 * d :] = np.concatenate([p["value"].reshape(d, h, d // h), np.zeros((d, h, 1), x.dtype)], axis=2).reshape(d, -1)
        into[d, 2 * d + d // h :: d // h + 1] = 1
        parts = np.split(self._product("parts", x, into).reshape(-1, n, 3 * d + h), (d, 2 * d), axis=2)
        return x, *(part.reshape(*part.shape[:2], h, -1).transpose(0, 2, 1, 3) for part in parts)

    def _weights(self, q: np.ndarray, k: np.ndarray, start: int, careful: bool) -> Iterator[tuple[int, int, np.ndarray]]:
        """Weights of attention, not normalised, of ``QUERIES`` places at a time (the first, the last), by keys up to the last."""
        n = q.shape[2]
        for first in range(start, n, QUERIES):
            last = min(first + QUERIES, n)
            a = self._product("a", q[:, :, first:last], k[:, :, :last].transpose(0, 1, 3, 2))
            a += np.ascontiguousarray(self.mask[first:last, :last])
            if careful:
                a -= a.max(axis=-1, keepdims=True)
            yield first, last, np.exp(a, out=a)

    def gradients(self, ids: np.ndarray, wanted: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log probability over the wanted places, and its gradient by parameter."""
        log_p, g, rows = self._backward(ids, wanted, targets)
        dense = np.zeros_like(self.p["ids"])
        dense[rows] = g["ids"]
        return float(-log_p.mean()), g | {"ids": dense}

    def _backward(
        self, ids: np.ndarray, wanted: np.ndarray, targets: np.ndarray, careful: bool = False
    ) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """Log probability at every wanted place, the gradient of their negative mean, and the rows of ids it has.

        Weights of attention stay unnormalised: their sums come out of the product as one more column, and go into it on the
        way back. Should exp leave its range, the largest exponent of each row is taken off first (``careful``).
        """
        p, (b, n), d, h = self.p, ids.shape, self.width, self.heads
        at, g = self.row_of.take(ids.ravel()), {}
        x, q, k, v = self._inputs(at, n)
        mixed = self._space("mixed", b, n, h, d // h + 1)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            a = self._product("a", q, k.transpose(0, 1, 3, 2))
            a += self.mask[:n, :n]
            if careful:
                a -= a.max(axis=-1, keepdims=True)
            # Most of what the mask hides is zero without being worked out.
            for first in range(0, n, QUERIES):
                last = min(first + QUERIES, n)
                np.exp(a[:, :, first:last, :last], out=a[:, :, first:last, :last])
                a[:, :, first:last, last:] = 0
            np.matmul(a, v, out=mixed.transpose(0, 2, 1, 3))
            total = mixed[..., -1:]
            o = np.divide(mixed[..., :-1], total, out=self._space("o", b, n, h, d // h))
        o_flat = o.reshape(b * n, d)
        chosen = np.flatnonzero(wanted)
        rows = self._rows("rows", x, chosen)
        rows[:, :d] += self._rows("out", o_flat, chosen) @ p["out"]
        act = self._product("act", rows, np.vstack([p["up"], p["up_bias"]]))
        np.maximum(act, 0, out=act)
        top = self._space("top", *rows.shape)
        top[:] = rows
        top[:, :d] += act @ p["down"]
        z = self._product("z", top, np.vstack([p["classes"], p["bias"]]))
        if careful:
            z -= z.max(axis=1, keepdims=True)
        place = np.arange(len(z))
        log_p = z[place, targets].astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            sums = np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype)
            log_p -= np.log(sums)
        if not careful and not (_in_range(sums) and _in_range(total)):
            return self._backward(ids, wanted, targets, True)
        # The gradient by z, before each row is divided by its sum and all by the number of rows.
        z[place, targets] -= sums
        part = (1 / (len(z) * sums))[:, None]
        got = (top * part).T @ z
        g["classes"], g["bias"] = got[:d], got[d]
        d_top = self._product("d_top", z, p["classes"].T)
        d_top *= part
        g["down"] = act.T @ d_top
        d_up = self._product("d_up", d_top, p["down"].T)
        d_up *= act > 0
        got = rows.T @ d_up
        g["up"], g["up_bias"] = got[:d], got[d]
        d_top += d_up @ p["up"].T
        dy = self._space("dy", b * n, d)
        dy[:] = 0
        dy[chosen] = d_top
        g["out"] = o_flat.T @ dy
        do = self._space("do", *mixed.shape)
        np.divide(self._product("out", dy, p["out"].T).reshape(o.shape), total, out=do[..., :-1])
        # The mean change over a row's weights is that of its output.
        np.negative(np.einsum("bnhe,bnhe->bnh", do[..., :-1], o), out=do[..., -1])
        do = do.transpose(0, 2, 1, 3)
        back = self._space("back", b, n, 3, h, d // h)
        dq, dk, dv = back.transpose(2, 0, 3, 1, 4)
        ds = self._product("ds", do, v.transpose(0, 1, 3, 2))
        ds *= a
        np.matmul(ds, k, out=dq)
        np.matmul(ds.transpose(0, 1, 3, 2), q, out=dk)
        np.matmul(a.transpose(0, 1, 3, 2), do[..., :-1], out=dv)
        back = back.reshape(b * n, 3 * d)
        g["query"], g["key"], g["value"] = np.split(x[:, :d].T @ back, 3, axis=1)
        scale = np.float32(1 / np.sqrt(d // h))
        g["query"] = g["query"] * scale
        dx = self._product("dx", back, np.concatenate([p["query"] * scale, p["key"], p["value"]], axis=1).T)
        dx += dy
        g["places"] = np.zeros_like(p["places"])
        g["places"][:n] = dx.reshape(b, n, d).sum(0)
        order = np.argsort(at.astype(np.uint16), kind="stable")
        held = at[order]
        begins = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        # Pairs of numbers are added as complex ones, which takes half the steps.
        pairs = self._rows("ids", dx, order).view(np.result_type(dx.dtype, np.complex64))
        g["ids"] = np.add.reduceat(pairs, begins).view(dx.dtype)
        return log_p, g, held[begins]

    def train(self, windows: np.ndarray, targets: np.ndarray, wanted: np.ndarray, steps: int, batch: int = 64, rate: float = 0.01) -> float:
        """Adam over random batches of windows with a falling rate; returns the last loss."""
        rng = np.random.default_rng(2)
        first = {n: np.zeros_like(v) for n, v in self.p.items()}
        second = {n: np.zeros_like(v) for n, v in self.p.items()}
        room = {n: np.empty_like(v) for n, v in self.p.items()}
        loss = float("nan")
        for step in range(1, steps + 1):
            some = rng.integers(0, len(windows), batch)
            loss, g = self.gradients(windows[some], wanted[some], targets[some][wanted[some]])
            now = rate * min(1.0, step / 20) * (1 - 0.95 * step / steps)
            for name, value in g.items():
                # In place: the table of ids is large, and fresh pages cost more than the sums.
                first[name] *= 0.9
                first[name] += np.multiply(value, 0.1, out=room[name])
                second[name] *= 0.99
                value *= value
                value *= 0.01
                second[name] += value
                fair = np.divide(second[name], 1 - 0.99**step, out=room[name])
                np.sqrt(fair, out=fair)
                fair += 1e-8
                np.divide(first[name], fair, out=fair)
                fair *= now / (1 - 0.9**step)
                self.p[name] -= fair
        return loss

    def copy(self) -> Attention:
        other = object.__new__(Attention)
        other.__dict__ |= self.__getstate__() | {"p": {n: v.copy() for n, v in self.p.items()}}
        return other


class Course:
    """Adam steps of one task over the windows that come by; rows of ids move when a batch holds them."""

    def __init__(self, attention: Attention) -> None:
        self.attention, self.steps, self.rng = attention, 0, np.random.default_rng(3)
        self.first = {n: np.zeros_like(v) for n, v in attention.p.items()}
        self.second = {n: np.zeros_like(v) for n, v in attention.p.items()}

    def learn(self, before: np.ndarray, targets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """One pass over sequences, every place once; its log probability just before its window was learned."""
        out = np.zeros(len(before))
        places, wanted = window_places(lengths, self.attention.length, self.attention.length)
        mixed = self.rng.permutation(len(places))
        for lot in range(0, len(mixed), BATCH):
            some = mixed[lot : lot + BATCH]
            at, scored = places[some], wanted[some]
            chosen = at[scored]
            out[chosen], g, rows = self.attention._backward(before[at], scored, targets[chosen])
            # A batch that the lot's end cuts short moves the weights less.
            self._step(g, rows, len(chosen) / (BATCH * self.attention.length))
        return out

    def _step(self, g: dict[str, np.ndarray], rows: np.ndarray, size: float) -> None:
        self.steps += 1
        now = RATE * min(1.0, self.steps / 20) / np.sqrt(1 + self.steps / 200) * min(1.0, size)
        fair = np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for name, value in g.items():
            moved = rows if name == "ids" else np.arange(len(value))
            first, second, p = (kept[name].take(moved, axis=0) for kept in (self.first, self.second, self.attention.p))
            first *= 0.9
            first += 0.1 * value
            second *= 0.99
            second += 0.01 * value * value
            self.first[name][moved], self.second[name][moved] = first, second
            self.attention.p[name][moved] = p - np.float32(now * fair) * first / (np.sqrt(second) + np.float32(1e-8))


def window_places(lengths: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the joined sequences) of every window, and which of them the window scores.

    A sequence's first window scores all its places; a later one only the last ``stride``, the rest is context.
    """
    begins = np.cumsum(lengths) - lengths
    windows = 1 + np.maximum(0, -(-(lengths - length) // stride))
    sequence = np.repeat(np.arange(len(lengths)), windows)
    number = np.arange(len(sequence)) - np.repeat(np.cumsum(windows) - windows, windows)
    span = np.arange(length)
    local = (number * stride)[:, None] + span
    wanted = (local < lengths[sequence][:, None]) & ((number == 0)[:, None] | (span >= length - stride))
    return begins[sequence][:, None] + np.minimum(local, lengths[sequence][:, None] - 1), wanted


@dataclass
class LanguageModel:
    """Everything a scoring task needs; its size is bounded by the numbers of ids and of head words."""

    attention: Attention
    class_of: np.ndarray  # by id
    log_share: np.ndarray  # natural log of the id's probability in its class, by id
    mixture: float  # the attention model's share of a word's probability
    head: dict[str, int]  # counts of the most frequent words
    whole_vocabulary: bool  # the head holds every training word
    train_tokens: int
    train_words: int  # distinct tokens
    stride: int = 32

    def id_scores(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log probability of every id of sequences that end with the end id."""
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[np.cumsum(lengths) - lengths] = END_ID
        out = np.zeros(len(ids))
        places, wanted = window_places(lengths, self.attention.length, self.stride)
        # Only a sequence's first window scores its first places.
        is_first = wanted[:, 0]
        for some, start in ((np.flatnonzero(is_first), 0), (np.flatnonzero(~is_first), self.attention.length - self.stride)):
            for lot in range(0, len(some), LOT):
                at, scored = places[some[lot : lot + LOT]], wanted[some[lot : lot + LOT]]
                chosen = at[scored]
                out[chosen] = self.attention.log_probabilities(before[at], scored, self.class_of[ids[chosen]], start)
        return out + self.log_share[ids]

    def head_counts(self) -> np.ndarray:
        """Counts by place in the head; -1 at place -1, that of all other words."""
        return np.array([*self.head.values(), -1])

    def word_log_p(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The attention model's log probability of every word, from the ids of texts and their numbers by text and by word."""
        return np.add.reduceat(self.id_scores(ids, lengths), np.cumsum(sizes) - sizes)

    def base_term(self, count) -> np.ndarray:
        return np.log10((count + 0.5) / (self.train_tokens + 0.5 * (self.train_words + 1)))

    def mixed_term(self, log_probability: np.ndarray, count: np.ndarray) -> np.ndarray:
        share = count / max(self.train_tokens, 1)
        return np.log10(self.mixture * np.exp(log_probability) + (1 - self.mixture) * share + 1e-300)


class WordTable(dict):
    """Numbers of words, given as texts or as their UTF-8 bytes; their ids and values in ``head`` stand in flat lists."""

    def __init__(self, encoding: tiktoken.Encoding, head: dict[str, int]) -> None:
        super().__init__()
        self.encoding, self.head = encoding, head
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.ends, self.counts, self.words = array("q"), array("q"), array("q"), []
        self[END_WORD]  # noqa: B018 - number 0

    def __missing__(self, key: str | bytes) -> int:
        word = key if isinstance(key, str) else key.decode()
        self.ids.extend([END_ID] if word == END_WORD else self.encoding.encode_ordinary(" " + word))
        self.ends.append(len(self.ids))
        self.counts.append(self.head.get(word, -1))
        self.words.append(word)
        self[key] = number = len(self.counts) - 1
        return number

    def encode(self, texts: list[list[str]] | list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Word numbers (each text ends with the end), word counts by text, ids and ids' counts by word."""
        per_text = np.array([len(w) + 1 for w in texts], np.int64)
        flat_words = chain.from_iterable((*words, END_WORD) for words in texts)
        numbers = np.fromiter(map(self.__getitem__, flat_words), np.int64, int(per_text.sum()))
        # The lists are read in place, so they cannot grow while a view of them lives.
        ends = np.frombuffer(self.ends, np.int64)
        sizes = np.diff(ends, prepend=0)[numbers]
        begin = ends[numbers] - sizes
        flat = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return numbers, per_text, np.frombuffer(self.ids, np.int64)[flat], sizes

    def counts_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.counts, np.int64)[numbers]


def _split(column: pa.Array) -> Iterator[list[bytes]]:
    """The words of every text, in UTF-8."""
    for cell in column.cast(pa.binary()):
        yield (cell.as_py() or b"").lower().split()


def _encode(texts: DataFrame, subword_path: str, head: dict[str, int]) -> DataFrame:
    """Rows of ``texts`` with, instead of the text, its ids, its words' places in the head (-1: not in it) and those outside."""
    marks = [c for c in texts.columns if c != "text"]
    kinds = dict(texts.dtypes)
    shared = texts.sparkSession.sparkContext.broadcast({word: place for place, word in enumerate(head)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(encoder(subword_path), shared.value)
        for batch in batches:
            lot, held, first = [], 0, 0
            for i, words in enumerate(_split(batch.column("text"))):
                lot.append(words)
                held += len(words) + 1
                if held > LOT_WORDS or i + 1 == batch.num_rows:
                    yield encoded(table, lot, batch.select(marks).slice(first, len(lot)))
                    lot, held, first = [], 0, i + 1
                    if len(table) > KNOWN_WORDS:
                        table.forget()

    def encoded(table: WordTable, lot: list[list[bytes]], kept: pa.RecordBatch) -> pa.RecordBatch:
        numbers, per_text, ids, sizes = table.encode(lot)
        ends = np.append(0, np.cumsum(per_text))
        places = table.counts_of(numbers).astype(np.int32)
        outside = np.flatnonzero(places < 0)
        loose = pa.array([table.words[number] for number in numbers[outside].tolist()], pa.string())
        columns = [
            _binary(ids.astype(np.uint16), np.append(0, np.cumsum(sizes))[ends]), _binary(places, ends),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(outside, ends), pa.int32()), loose),
        ]
        return pa.RecordBatch.from_arrays([*kept.columns, *columns], [*marks, "ids", "places", "loose"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in marks), "ids binary, places binary, loose array<string>"])
    return texts.mapInArrow(encode, schema)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary for each row, from the rows' values in one array."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What ``_binary`` has stored: the values of all rows, and where each row's begin (one more at the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, kind), np.zeros(len(column) + 1, np.int64)
    held = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return held.view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


@dataclass
class Lot:
    """Encoded texts that follow one another in a batch."""

    first: int  # the number of its first row in the batch
    ids: np.ndarray
    lengths: np.ndarray  # ids by text
    sizes: np.ndarray  # ids by word
    per_text: np.ndarray  # words by text
    places: np.ndarray  # words' places in the head

    def before(self) -> np.ndarray:
        """The id before every id."""
        out = np.append(END_ID, self.ids[:-1])
        out[np.cumsum(self.lengths) - self.lengths] = END_ID
        return out


def _lots(batch: pa.RecordBatch, begins_word: np.ndarray) -> Iterator[Lot]:
    """A batch of ``_encode``, some ``LOT_WORDS`` words at a time."""
    ids, id_ends = _values(batch.column("ids"), np.uint16)
    places, word_ends = _values(batch.column("places"), np.int32)
    first = 0
    while first < batch.num_rows:
        last = min(int(np.searchsorted(word_ends, word_ends[first] + LOT_WORDS, side="right")), batch.num_rows)
        held = ids[id_ends[first] : id_ends[last]].astype(np.int64)
        begins = np.flatnonzero(begins_word[held])
        yield Lot(
            first, held, np.diff(id_ends[first : last + 1]), np.diff(begins, append=len(held)),
            np.diff(word_ends[first : last + 1]), places[word_ends[first] : word_ends[last]],
        )
        first = last


def _word_begins(encoding: tiktoken.Encoding) -> np.ndarray:
    """Whether an id begins a word (or is the end): those with the blank in front, which stands nowhere else in a word."""
    out = np.zeros(N_IDS, bool)
    out[[i for i in range(END_ID) if encoding.decode_single_token_bytes(i)[:1] == b" "]] = True
    out[END_ID] = True
    return out


def _own_classes(counts: np.ndarray, own: int, groups: int) -> np.ndarray:
    """The ``own`` most frequent ids as classes of their own, all others in the last class."""
    class_of = np.full(N_IDS, own + groups - 1, np.int64)
    class_of[np.argsort(-counts, kind="stable")[:own]] = np.arange(own)
    return class_of


def _neighbours(class_of: np.ndarray, own: int, ids: np.ndarray, total: np.ndarray) -> None:
    """Count into ``total`` (N_IDS rows) the classes of their own before and after each id that has none."""
    column = np.where(class_of[ids] < own, class_of[ids], own)
    cells = total.reshape(-1)
    for here, other, shift in ((slice(1, None), slice(None, -1), 0), (slice(None, -1), slice(1, None), own + 1)):
        used = column[here] == own
        np.add.at(cells, ids[here][used] * total.shape[1] + column[other][used] + shift, 1)


def _grouped(class_of: np.ndarray, own: int, groups: int, shown: np.ndarray, profile: np.ndarray) -> np.ndarray:
    """Ids without a class of their own in classes by the neighbours that ``profile`` counts for the ``shown`` ones."""
    if len(shown) == 0 or groups < 2:
        return class_of
    weight = profile.sum(1)
    profile = np.sqrt(profile / np.maximum(weight, 1)[:, None])
    centres = profile[np.argsort(-weight, kind="stable")[: groups - 1]]
    squares, twice = (profile**2).sum(1)[:, None], 2 * profile
    for _ in range(12):
        nearest = (squares - twice @ centres.T + (centres**2).sum(1)).argmin(1)
        for g in range(len(centres)):
            if (nearest == g).any():
                centres[g] = np.average(profile[nearest == g], axis=0, weights=weight[nearest == g] + 1e-9)
    class_of = class_of.copy()
    class_of[shown] = own + nearest
    return class_of


def _classes(counts: np.ndarray, ids: np.ndarray, own: int, groups: int) -> np.ndarray:
    """A class for every id: the ``own`` most frequent alone, others grouped by the neighbours they have in ``ids``."""
    class_of = _own_classes(counts, own, groups)
    total = np.zeros((N_IDS, 2 * (own + 1)), np.int32)
    _neighbours(class_of, own, ids, total)
    shown = np.setdiff1d(np.unique(ids), np.flatnonzero(class_of < own))
    return _grouped(class_of, own, groups, shown, total[shown].astype(np.float64))


def _blocks(values: np.ndarray) -> Iterator[bytes]:
    for start in range(0, len(values), BLOCK):
        yield values[start : start + BLOCK].tobytes()


def _all_classes(training: DataFrame, counts: np.ndarray, subword_path: str, own: int, groups: int) -> np.ndarray:
    """The classes of ``_classes`` from all training texts, encoded or not; tasks count neighbours, blocks of ids are added up apart."""
    class_of, width = _own_classes(counts, own, groups), 2 * (own + 1)
    encoded = training if "ids" in training.columns else _encode(training.select("text"), subword_path, {})
    begins_word = _word_begins(encoder(subword_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_IDS, width), np.int32)
        for batch in batches:
            for lot in _lots(batch, begins_word):
                _neighbours(class_of, own, lot.ids, total)
        for number, held in enumerate(_blocks(total)):
            if any(held):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([held], pa.binary())], ["block", "held"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(held, np.int32).astype(np.int64) for held in rows["held"])
        return pd.DataFrame({"block": rows["block"].iloc[:1], "held": [total.astype(np.float32).tobytes()]})

    parts = encoded.select("ids", "places").mapInArrow(count, "block int, held binary")
    shown, profiles = [], []
    # A row for each block of ids, whatever the corpus.
    for row in parts.groupBy("block").applyInPandas(add, "block int, held binary").orderBy("block").toLocalIterator():
        block = np.frombuffer(row.held, np.float32).reshape(-1, width)
        met = np.flatnonzero(block.any(axis=1))
        shown.append(row.block * BLOCK + met)
        profiles.append(block[met])
    if not shown:
        return class_of
    return _grouped(class_of, own, groups, np.concatenate(shown), np.concatenate(profiles))


def word_counts(documents: DataFrame) -> DataFrame:
    """word and n of every token, the end among them as ``END_WORD``; partial counts are formed in the scan."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for words in _split(batch.column("text")):
                found.update(words)
            found[END_WORD.encode()] += batch.num_rows
            if len(found) > KNOWN_WORDS:
                yield flush()
                found.clear()
        if found:
            yield flush()

    return documents.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _id_counts(words: DataFrame, subword_path: str) -> np.ndarray:
    """Counts of every subword id in the training corpus, from the counts of its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, total = encoder(subword_path), np.zeros(N_IDS, np.int64)
        for batch in batches:
            words = batch.column("word").to_pylist()
            ids = [[END_ID] if word == END_WORD else encoding.encode_ordinary(" " + word) for word in words]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            np.add.at(total, np.fromiter(chain.from_iterable(ids), np.int64, sizes.sum()), np.repeat(batch.column("n").to_numpy(), sizes))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["id", "n"])

    rows = words.mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # 50,257 at most
    out = np.zeros(N_IDS)
    for row in rows:
        out[row.id] = row.n
    return out


def _sample(training: DataFrame, n: int) -> list[list[str]]:
    """The words of the ``n`` distinct training texts with the smallest hashes; texts of equal words stand there once."""
    placed = training.filter("text is not null").select("text", F.xxhash64("text").alias("place"))
    last = placed.select("place").distinct().orderBy("place").limit(n).agg(F.max("place")).first()[0]
    if last is None:
        return []
    chosen = placed.filter(F.col("place") <= last).dropDuplicates(["place", "text"]).orderBy("place", "text")
    known: dict[str, str] = {}
    texts = dict.fromkeys(tuple(known.setdefault(w, w) for w in words_of(r.text)) for r in chosen.select("text").toLocalIterator())
    return [list(words) for words in texts]


def _spread(windows: np.ndarray, budget: int) -> np.ndarray:
    """Which windows of texts with so many windows each are used: all of short texts, evenly spaced ones of long texts.

    The number that a text may use is as large as the budget lets it be, and the same for all texts.
    """
    low, high = 0, int(windows.max(initial=0))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if np.minimum(windows, middle).sum() <= budget else (low, middle - 1)
    used = np.minimum(windows, low)
    longer = np.flatnonzero(windows > low)[: max(0, budget - int(used.sum()))]
    used[longer] += 1
    owner = np.repeat(np.arange(len(windows)), windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    return (number + 1) * used[owner] // windows[owner] > number * used[owner] // windows[owner]


def fit_language_model(
    training: DataFrame, words: DataFrame, subword_path: str, sample_texts: int = 1000, sample_ids: int = 400_000,
    steps: int = 500, own_classes: int = 96, groups: int = 32, head_words: int = HEAD_WORDS,
) -> LanguageModel:
    """Fit on all training texts and their counts (``words``).

    The attention model starts with ``steps`` steps over windows of ``sample_ids`` ids of the ``sample_texts`` distinct texts
    with the smallest hashes; the three numbers grow with the square root of the training tokens above ``SMALL_CORPUS``.
    Then it learns from all training texts. Without any, all ids are equally likely in their classes and the attention
    model stays as it was drawn.
    """
    head = _head(words, head_words)
    encoded = _encode(training.select("text"), subword_path, head)
    return _fit(training, encoded, words, head, subword_path, sample_texts, sample_ids, steps, own_classes, groups)


def _head(words: DataFrame, n: int = HEAD_WORDS) -> dict[str, int]:
    """The most frequent words and their counts."""
    frequent = words.orderBy(F.desc("n"), "word").limit(n).toArrow()
    return dict(zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist()))


def _fit(
    training: DataFrame, encoded: DataFrame, words: DataFrame, head: dict[str, int], subword_path: str, sample_texts: int = 1000,
    sample_ids: int = 400_000, steps: int = 500, own_classes: int = 96, groups: int = 32,
) -> LanguageModel:
    """``fit_language_model`` on training texts that are at hand in ``encoded`` form, too."""
    tokens, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    counts = _id_counts(words, subword_path)
    growth = max(1.0, (tokens or 0) / SMALL_CORPUS) ** 0.5
    sample_texts, sample_ids, steps = (int(growth * n) for n in (sample_texts, sample_ids, steps))
    table = WordTable(encoder(subword_path), head)
    texts = _sample(training, sample_texts)
    if not texts:
        texts, steps = [[]], 0
    _, per_text, ids, sizes = table.encode(texts)
    attention = Attention(own_classes + groups, np.flatnonzero(counts))
    lengths = np.bincount(np.repeat(np.repeat(np.arange(len(texts)), per_text), sizes), minlength=len(texts))
    class_of = _all_classes(encoded, counts, subword_path, own_classes, groups) if tokens else _own_classes(counts, own_classes, groups)
    smooth = counts + 0.5
    in_class = np.bincount(class_of, smooth, own_classes + groups)
    log_share = np.log(smooth / in_class[class_of])
    model = LanguageModel(attention, class_of, log_share, 0.5, head, len(head) == distinct, tokens or 0, distinct)
    attention.p["bias"] = np.log(in_class + 1e-9).astype(np.float32)
    attention.p["bias"] -= attention.p["bias"].max()
    if steps:
        places, wanted = window_places(lengths, attention.length, model.stride)
        owner = np.searchsorted(np.cumsum(lengths), places[:, 0], side="right")
        learned = np.flatnonzero(_spread(np.bincount(owner, minlength=len(texts)), max(1, sample_ids // model.stride)))
        before = np.append(END_ID, ids[:-1])
        before[np.cumsum(lengths) - lengths] = END_ID
        attention.train(before[places[learned]], class_of[ids[places[learned]]], wanted[learned], steps)
        # Ids that the sample does not show start where its ids are on average.
        known = attention.row_of[np.unique(ids)]
        unseen = np.setdiff1d(np.arange(len(attention.p["ids"])), known)
        attention.p["ids"][unseen] = attention.p["ids"][known].mean(axis=0)
    if tokens:
        _learn_all(model, encoded, words, subword_path)
    return model


def _learn_all(model: LanguageModel, encoded: DataFrame, words: DataFrame, subword_path: str) -> None:
    """Take the attention model through all (encoded) training texts, and fit the mixture to the probabilities met on the way.

    Every task starts from the same weights and learns its own texts once; a weight's value is the mean over the tasks, by
    their ids. Its blocks are averaged apart, so no task or driver holds all tasks' weights.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    shapes = {name: value.shape for name, value in model.attention.p.items()}
    begins_word = _word_begins(encoder(subword_path))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        course, head = Course(model.attention.copy()), model.head_counts()
        seen, ratios = 0, Counter()
        for batch in batches:
            loose = batch.column("loose").flatten()
            used = 0
            for lot in _lots(batch, begins_word):
                seen += len(lot.ids)
                log_p = course.learn(lot.before(), model.class_of[lot.ids], lot.lengths) + model.log_share[lot.ids]
                log_p = np.add.reduceat(log_p, np.cumsum(lot.sizes) - lot.sizes)
                inside = lot.places >= 0
                met, n = np.unique(_ratio_steps(log_p[inside], head[lot.places[inside]]), return_counts=True)
                ratios.update(dict(zip(met.tolist(), n.tolist())))
                outside = log_p[~inside]
                yield _learned(word=loose.slice(used, len(outside)), log_p=outside)
                used += len(outside)
        yield _learned(step=list(ratios), n=list(ratios.values()))
        if seen:
            for name, value in course.attention.p.items():
                held = list(_blocks(value))
                yield _learned(n=[seen] * len(held), name=[name] * len(held), block=list(range(len(held))), held=held)

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(n * np.frombuffer(held, np.float32).astype(np.float64) for n, held in zip(rows["n"], rows["held"]))
        mean = (total / rows["n"].sum()).astype(np.float32)
        return pd.DataFrame({"name": rows["name"].iloc[:1], "block": rows["block"].iloc[:1], "held": [mean.tobytes()]})

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met, n = np.unique(_ratio_steps(batch.column("log_p").to_numpy(), batch.column("n").to_numpy()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n, pa.int64())], ["step", "n"])

    learned = materialise(encoded.select("ids", "places", "loose").mapInArrow(learn, _LEARNED), "learned")
    kept = learned.filter("held is not null").select("name", "block", "n", "held")
    blocks = kept.groupBy("name", "block").applyInPandas(average, "name string, block int, held binary").orderBy("name", "block")
    found = {name: [] for name in shapes}
    # The weights once, whatever the number of tasks.
    for row in blocks.toLocalIterator():
        found[row.name].append(np.frombuffer(row.held, np.float32))
    for name, shape in shapes.items():
        model.attention.p[name] = np.concatenate(found[name]).reshape(shape)
    loose = learned.filter("word is not null").select("word", "log_p").join(words, "word").select("log_p", "n")
    ratios = learned.filter("step is not null").select("step", "n").unionByName(loose.mapInArrow(steps, "step int, n long"))
    rows = ratios.groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()  # bounded by the range of steps
    model.mixture = _fit_mixture(np.array([r.step for r in rows]), np.array([r.n for r in rows], float), model.train_tokens)
    shared.unpersist()
    release(learned)


_LEARNED = "word string, log_p double, step int, n long, name string, block int, held binary"
_LEARNED_TYPES = [pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary()]


def _learned(**columns) -> pa.RecordBatch:
    """Rows of what a task has learned; columns that are not named are null."""
    rows = len(next(iter(columns.values())))
    names = [column.split()[0] for column in _LEARNED.split(", ")]
    given = [pa.array(columns[n], t) if n in columns else pa.nulls(rows, t) for n, t in zip(names, _LEARNED_TYPES)]
    return pa.RecordBatch.from_arrays(given, names)


# Stands for words whose other occurrences are none, so that the attention model alone can give them.
_ALONE = 1 << 20


def _ratio_steps(log_p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Logarithm, in steps, of a word's attention probability by its count, its own occurrence left out of it."""
    others = count - 1
    steps = np.floor(FINE * (log_p - np.log(np.maximum(others, 1)))).astype(np.int64)
    return np.where(others > 0, np.clip(steps, -_ALONE, _ALONE - 1), _ALONE)


def _fit_mixture(steps: np.ndarray, n: np.ndarray, tokens: int) -> float:
    """The share that makes the words likeliest, ``n`` of them in each step of ``_ratio_steps``."""
    # The middle of a step, as attention probability by frequency.
    ratio = np.exp(np.minimum((steps + 0.5) / FINE + np.log(tokens), 700))
    mixture = 0.5
    for _ in range(30):
        part = np.where(steps == _ALONE, 1.0, mixture * ratio / (mixture * ratio + 1 - mixture))
        mixture = float(np.clip(np.average(part, weights=n), 0.02, 0.98))
    return mixture


def word_scores(model: LanguageModel, table: WordTable, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The attention model's log probability and the head's count (-1: not in it) of every word, and words by text."""
    numbers, per_text, ids, sizes = table.encode(texts)
    lengths = np.add.reduceat(sizes, np.cumsum(per_text) - per_text)
    return model.word_log_p(ids, lengths, sizes), table.counts_of(numbers), per_text


_SCAN = (
    "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, "
    "rest array<struct<word:string,log_p:double>>"
)


def _scan(encoded: DataFrame, model: LanguageModel, subword_path: str) -> DataFrame:
    """Each text's sums over words in the head; other words are handed on."""
    begins_word = _word_begins(encoder(subword_path))
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        head = model.head_counts()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lot in _lots(batch, begins_word):
                yield _scored(model, head, lot, batch.slice(lot.first, len(lot.lengths)), row)
                row += len(lot.lengths)

    return encoded.select("doc_id", "ids", "places", "loose").mapInArrow(scan, _SCAN)


def _scored(model: LanguageModel, head: np.ndarray, lot: Lot, texts: pa.RecordBatch, row: int) -> pa.RecordBatch:
    log_p, count = model.word_log_p(lot.ids, lot.lengths, lot.sizes), head[lot.places]
    inside = count >= 0
    known = inside | model.whole_vocabulary
    begins = np.cumsum(lot.per_text) - lot.per_text
    count = np.maximum(count, 0)
    sums = [
        np.add.reduceat(np.where(known, values, 0.0), begins) for values in (count > 0, model.base_term(count), model.mixed_term(log_p, count))
    ]
    # With the whole vocabulary in the head, no other word has a count to look for.
    outside = np.flatnonzero(~known)
    words = texts.column("loose").flatten() if len(outside) else pa.array([], pa.string())
    loose = pa.StructArray.from_arrays([words, pa.array(log_p[outside])], ["word", "log_p"])
    rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(outside, np.append(begins, len(count))), pa.int32()), loose)
    columns = [
        pa.array(np.arange(row, row + len(begins))), texts.column("doc_id"), pa.array(lot.per_text),
        pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), rest,
    ]
    return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rest"])


def language_scores(documents: DataFrame, model: LanguageModel, words: DataFrame, subword_path: str) -> DataFrame:
    """One row per row: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    A null or empty text is the end alone. Repeated rows are scored alike; no documents give no rows. Columns besides
    doc_id and text are not read. The order of additions may differ between runs in the last digits.
    """
    texts = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    return _sums(_scan(_encode(texts, subword_path, model.head), model, subword_path), model, words)


def _sums(scan: DataFrame, model: LanguageModel, words: DataFrame) -> DataFrame:
    """The scores of ``_scan``, with the words outside the head added to them."""
    scanned = materialise(scan, "scored")
    loose = scanned.select("row", F.inline("rest")).join(words, "word", "left")
    count = F.coalesce(F.col("n"), F.lit(0))
    total = float(model.train_tokens + 0.5 * (model.train_words + 1))
    mixed = F.lit(model.mixture) * F.exp("log_p") + (1 - F.lit(model.mixture)) * count / F.lit(float(max(model.train_tokens, 1)))
    late = loose.groupBy("row").agg(
        F.sum((count > 0).cast("long")).alias("known"),
        F.sum(F.log10((count + 0.5) / F.lit(total))).alias("base"),
        F.sum(F.log10(mixed + F.lit(1e-300))).alias("mixed"),
    )
    added = lambda here, there: (F.col(here) + F.coalesce(F.col(there), F.lit(0))).alias(here)
    return scanned.drop("rest").join(late, "row", "left").select(
        "doc_id", "n_tokens", added("n_known", "known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        added("base_score", "base"), added("score", "mixed"),
    )


def score_with_training(documents: DataFrame, training: DataFrame | Column, subword_path: str) -> DataFrame:
    """Fit on ``training`` and score ``documents``.

    Training texts are a table of their own, or those rows of ``documents`` for which a condition holds. All texts are
    encoded once; the ids are stored for the fit and for the scores.
    """
    columns = lambda doc_id, scored, learned: (doc_id.cast("long").alias("doc_id"), "text", scored.alias("scored"), learned.alias("learned"))
    yes, no = F.lit(True), F.lit(False)
    if isinstance(training, Column):
        texts, training = documents.select(*columns(F.col("doc_id"), yes, F.coalesce(training, no))), documents.filter(training)
    else:
        texts = documents.select(*columns(F.col("doc_id"), yes, no)).unionAll(training.select(*columns(F.lit(None), no, yes)))
    words = materialise(word_counts(training), "words")
    head = _head(words)
    encoded = materialise(_encode(texts, subword_path, head), "encoded", codec="zstd")
    model = _fit(training, encoded.filter("learned"), words, head, subword_path)
    scored = _sums(_scan(encoded.filter("scored"), model, subword_path), model, words)
    release(encoded)
    return scored
