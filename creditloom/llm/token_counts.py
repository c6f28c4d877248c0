"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of pieces that are popped when the link is
followed. One left-to-right scan of a word then gives the number of pieces that greedy longest matching would cut it
into; no piece is ever built and no byte is read twice.

A word is a maximal run without ASCII white space. It is matched with one space before it, as the vocabulary of a
byte-level tokenizer writes the start of a word. Every single byte is a piece, so each word can be matched.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# A worker forgets its known words beyond this many; the counts do not depend on it.
KNOWN_WORDS = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable character by which a byte-level vocabulary file writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, without its special tokens."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model["added_tokens"]}
    alphabet = byte_alphabet()
    return [bytes(alphabet[c] for c in piece) for piece in model["model"]["vocab"] if piece not in special]


class LongestMatch:
    """The automaton of one vocabulary, which must contain every single byte that occurs."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        self.children: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                node = self.children[node].setdefault(byte, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    is_piece.append(False)
            is_piece[node] = bool(piece)
        self.failure = [-1] * len(self.children)
        self.popped = [0] * len(self.children)
        level = [0]
        while level:
            following = []
            for parent in level:
                for byte, node in self.children[parent].items():
                    following.append(node)
                    if is_piece[node]:
                        self.failure[node], self.popped[node] = 0, 1
                        continue
                    popped, at = self.popped[parent], self.failure[parent]
                    while at >= 0 and byte not in self.children[at]:
                        popped, at = popped + self.popped[at], self.failure[at]
                    if at >= 0:
                        self.failure[node], self.popped[node] = self.children[at][byte], popped
            level = following

    def count(self, word: bytes) -> int:
        """The number of pieces of ``word``."""
        children, failure, popped = self.children, self.failure, self.popped
        node = total = 0
        for byte in word:
            while byte not in children[node]:
                total += popped[node]
                node = failure[node]
                if node < 0:
                    raise ValueError(f"the vocabulary has no piece for byte {byte}")
            node = children[node][byte]
        while node > 0:
            total += popped[node]
            node = failure[node]
        if node < 0:
            raise ValueError("the vocabulary cannot end this word")
        return total


class WordCounts(dict):
    """Pieces by word, filled as words appear."""

    def __init__(self, automaton: LongestMatch) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = count = self.automaton.count(b" " + word)
        return count


def token_counts(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_words and n_tokens of its whole text.

    A null or empty text, or one of white space only, has no words and no tokens. Repeated rows are counted one by
    one; columns besides doc_id and text are not read. ``vocabulary_path`` is read on the driver.
    """
    vocabulary = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCounts(LongestMatch(vocabulary.value))
        for batch in batches:
            n_bytes, n_words, n_tokens = [], [], []
            for text in batch.column("text"):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.split()
                n_bytes.append(len(raw))
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_bytes, n_words, n_tokens))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_words", "n_tokens"])

    schema = "doc_id long, n_bytes long, n_words long, n_tokens long"
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(count, schema)
