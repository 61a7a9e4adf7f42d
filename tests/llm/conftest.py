from __future__ import annotations

import pytest

#: Texts that every operator has to take: null, empty, blank, ties, copies, long, odd characters.
ODD = [None, "", "   ", "\n\n", "one", "a b c d", "a b c d e", "Same line\nSame line\n", "Same line\nSame line\n", "é ß 中文 😀 \x85   x", "word " * 30000, "x" * 200000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with repeated and null ids, a repeated row, and columns that clash with results."""
    rows = [(None if i == 3 else i // 2, t, "en", "s", None, 7, "k") for i, t in enumerate(ODD)]
    rows.append(rows[4])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string")
