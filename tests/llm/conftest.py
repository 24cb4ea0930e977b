from __future__ import annotations

import pytest

#: id, text: nulls, empty and very long texts, ties, copies, repeated rows.
LONG = " ".join(f"word{i % 977} and tail{i % 31}." for i in range(12_000))
BASE = " ".join(f"alpha{i} beta{i * 7 % 50}" for i in range(60))
ROWS = [
    (1, None, "en"),
    (2, "", "en"),
    (3, "   \n\t ", None),
    (4, LONG, "en"),
    (5, BASE, "en"),
    (6, BASE.upper(), "de"),
    (7, BASE.replace("alpha3 ", "gamma "), "de"),
    (7, BASE.replace("alpha3 ", "gamma "), "de"),
    (8, "Zwei Worte", None),
    (9, "zwei worte", "de"),
    (10, "été 漢字 ́x 💥 \x1c mixed", "fr"),
    (11, LONG + " end", "en"),
    (None, "no id here", "en"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every odd case, and extra columns whose names clash with internal ones."""
    rows = [(i, t, lang, 1, "x", [2], -5, True) for i, t, lang in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_words int, digest string, bands array<int>, rank int, kept boolean")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
