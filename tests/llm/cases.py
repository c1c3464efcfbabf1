"""Texts and tables that operators must bear: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random


def texts() -> list[str]:
    random.seed(1)
    made = ["", "a", "  ", "\n\t x", "ab" * 1500, "x" * 700, "日本語テキスト😀" * 20, "ü" * 193, "It's we'll don't 123 4567", "the quick brown fox"]
    for _ in range(30):
        made.append("".join(chr(random.choice([random.randrange(32, 127), random.randrange(0x3040, 0x30FF), 10, 32])) for _ in range(200)))
    return made


def odd_docs(spark):
    """Columns of documents and two that operators use inside."""
    rows = [
        (1, "The quick brown fox jumps over it.", "en", "a", 3, "x"), (1, "The quick brown fox jumps over it.", "en", "a", 3, "x"), (2, None, None, "a", 0, None), (3, "", "en", None, 0, "y"), (4, "   \n ", "de", "b", 4, "z"),
        (5, "word " * 30_000, "fr", "b", 5, "z"), (6, "12345 !!!", None, "b", 5, "z"), (7, "tie", "es", "c", 5, "z"), (7, "tie two", "es", "c", 5, "z"), (None, "nobody's text", "en", None, 1, "q"), (8, "x" * 50_000, "en", "c", 1, "q"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string").repartition(3)
