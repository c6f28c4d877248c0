from __future__ import annotations

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from creditloom.llm.token_counts import LongestMatch, read_vocabulary, token_counts

SMALL = [bytes([b]) for b in b" abcd"] + [b" a", b" ab", b"abc", b"bcd", b"cdab", b"dd", b" abcda", b"abcdabc"]


def greedy(word: bytes, vocabulary: set[bytes]) -> int:
    count = 0
    while word:
        word = word[max(n for n in range(1, len(word) + 1) if word[:n] in vocabulary) :]
        count += 1
    return count


@settings(max_examples=400, deadline=None)
@given(st.text(" abcd", max_size=30).map(str.encode))
def test_automaton_equals_greedy_longest_match(word):
    assert LongestMatch(SMALL).count(word) == greedy(word, set(SMALL))


def test_documents_equal_greedy_longest_match(documents_of, odd_texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = set(read_vocabulary(path))
    texts = [t for t in odd_texts if t is None or len(t) < 6000]
    found = {r.doc_id: r for r in token_counts(documents_of(texts), path).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        assert found[i].n_words == len(words)
        assert found[i].n_bytes == len((text or "").encode())
        assert found[i].n_tokens == sum(greedy(b" " + w, vocabulary) for w in words)


def test_no_documents(documents_of):
    assert token_counts(documents_of([]), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
