"""The session of the other tests, with awkward documents."""

from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns with clashing names."""
    base = " ".join(f"word{k} thing{k % 7}" for k in range(60))
    rows = [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, base + " more words at the end", None), (4, None, None),
        (5, "", "en"), (6, "   \n\t ", "fr"), (7, "four words are here", "en"), (8, "FOUR words are\there", "en"),
        (9, "x" * 3000, "de"), (10, base.replace("word3 ", "other "), "en"), (None, "no id here", "en"), (11, "123 456 !!!", "en"),
        (12, "long " * 5000, "en"), (13, "don't <|im_end|> 你好  naïve  12ab\n", "en"),
    ]
    data = [(*r, "a", "b", "c", "d", "e") for r in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, id string, rep string, key string, n string, _text string")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
