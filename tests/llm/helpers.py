"""Small tables with the cases every operator has to stand."""

from __future__ import annotations

import random

ODD_TEXTS = [None, "", " ", "\n\n", "a", "é ü ß", "word " * 3000, "same line\nsame line\nsame line", "x" * 5000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, digest string, kept boolean, items string, _row long, _before string, _quality_n_words long"


def docs_of(spark, texts, first=0):
    """A documents table with further columns whose names clash with the operators' own."""
    rows = [(first + i, t, "en", f"src{i % 3}", len(t or ""), -1, "d", None, "i", 7, "b", 8) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(seed: int, n: int, size: int = 200) -> list[str]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(size)]
    return [r.choice(vocabulary) for _ in range(n)]


def text(seed: int, n: int = 120) -> str:
    return " ".join(words(seed, n, 2000))
