from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents_of(spark):
    """A documents table from texts (ids count up) or from (id, text) pairs; with columns that names may clash with."""

    def build(texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in pairs]
        extra = "bucket long, key string, size string, kept string, score string, label string, row string"
        rows = [(*r, 1, "k", "s", "kept", "x", "y", "z") for r in rows]
        return spark.createDataFrame(rows, f"{SCHEMA}, {extra}").repartition(3)

    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Empty, null, blank, repeated, one-word, long-word, accented and very long texts."""
    sentence = "the quick brown fox jumps over the lazy dog near the river bank while it rains "
    return [
        None, "", "   \n\t ", "word", "word", "Ärger über große Straßen naïve café " * 4, "x" * 5000, sentence * 3, sentence * 3,
        sentence * 3 + "and more", " ".join(f"w{i % 97}q{i % 89}" for i in range(30000)), "🙂🙃 " * 30, "\x0bone\x0ctwo",
    ]
