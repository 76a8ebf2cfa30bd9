"""Golden rows for text functions that SQL cannot express."""

import pytest

from wakeline.functions import text as T

CARDS = [
    ("paid with 4111 1111 1111 1111 today", "paid with [card] today"),
    ("4111-1111-1111-1111", "[card]"),
    ("4111111111111111", "[card]"),
    ("amex 378282246310005.", "amex [card]."),
    ("4111 1111 1111 1112", "4111 1111 1111 1112"),
    ("9111111111111111", "9111111111111111"),
    ("ssn 123-45-6789", "ssn [ssn]"),
    ("000-45-6789 666-45-6789 923-45-6789 123-00-6789 123-45-0000", "000-45-6789 666-45-6789 923-45-6789 123-00-6789 123-45-0000"),
    ("call 555-123-4567", "call 555-123-4567"),
    ("[card] and [ssn]", "[card] and [ssn]"),
    ("", ""),
    (None, None),
]


def test_redact(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CARDS)], "i int, text string").select("i", T.redact().alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [want for _, want in CARDS]


@pytest.mark.parametrize("text,want", [("File File Edit", "File Edit"), ("Ask ask now", "Ask now"), ("26 26 a a", "26 26 a a"), ("go go go on", "go on"), (None, None)])
def test_collapse(spark, text, want):
    assert spark.createDataFrame([(text,)], "text string").select(T.collapse_doubled()).first()[0] == want


def test_credential_order(spark):
    rows = [("password: x 123-45-6789",), ("api_key=abc",), ("nothing",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "text string").coalesce(1).select(T.credential()).collect()] == ["SSN-like number", "API key", None, None]
