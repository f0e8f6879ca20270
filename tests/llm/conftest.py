from __future__ import annotations

import pytest

from folio.llm.common import documents
from folio.session import ship_package

SMALL = "/root/testdata/sf0.001"
CHECK = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def texts(llm):
    return {r.doc_id: r.text for r in documents(llm, SMALL).collect()}


@pytest.fixture
def odd(llm):
    """Nulls everywhere, empty and long texts, repeated rows, clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [
        (1, "one two three four five six", "en", "a", 3),
        (1, "one two three four five six", "en", "a", 3),
        (None, None, None, None, None),
        (None, "one two three four five six", None, None, 3),
        (4, "", "en", "a", 0),
        (5, " \t\n ", "fr", "b", 4),
        (6, long, "fr", "b", len(long)),
        (7, "ñandú été 日本語 \U0001f600", "fr", None, 1),
        (8, "12345 !!!", "en", "a", 9),
    ]
    df = llm.createDataFrame(rows, DOCS)
    clash = {c: 0 for c in ("score", "kept", "taken", "size", "spans", "class_id", "lang_pred", "text_sha256")}
    return df.selectExpr("*", *[f"{v} as {k}" for k, v in clash.items()])


@pytest.fixture
def empty(llm):
    return llm.createDataFrame([], DOCS)
