"""A vocabulary of the caller's."""

import pytest

from wakeline.llm import url_filter

URLS = "page_id long, url string"


def verdicts(spark, urls, terms, **how):
    pages = spark.createDataFrame(list(enumerate(urls)), URLS)
    vocabulary = spark.createDataFrame(terms, "term string, strict boolean, extra int")
    rows = url_filter.judge_urls(pages, (), vocabulary, **how).orderBy("page_id").collect()
    return [(r.verdict, r.strict_hits, r.soft_hits, r.soft_terms) for r in rows]


def test_terms_of_a_table(spark):
    urls = ["http://a.b/Gamble", "http://a.b/gambler", "http://a.b/raffle/raffle", "http://a.b/raffle-lotto", "http://a.b/free-spin?x", None, "", "http://a.b/casino"]
    terms = [("GAMBLE", True, 1), ("gamble", False, 1), ("raffle", False, 1), ("lotto", None, 1), ("free-spin", True, 1), (None, True, 1), ("", True, 1)]
    assert verdicts(spark, urls, terms) == [("block", 1, 0, 0), ("allow", 0, 0, 0), ("allow", 0, 2, 1), ("block", 0, 2, 2), ("block", 1, 0, 0), ("allow", 0, 0, 0), ("allow", 0, 0, 0), ("allow", 0, 0, 0)]
    assert [v[0] for v in verdicts(spark, urls[2:4], terms, enough=1)] == ["block", "block"]
    assert {v[0] for v in verdicts(spark, urls, [])} == {"allow"}


def test_a_vocabulary_that_is_too_long_is_refused(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "VOCABULARY_ROWS", 2)
    with pytest.raises(ValueError):
        verdicts(spark, ["x"], [("a", True, 1), ("b", True, 1), ("c", True, 1)])
