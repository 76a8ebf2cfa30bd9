"""Words and phrases of a search without an index are counted inside their row: no word is shuffled by its place in a text."""

from collections import Counter

from pyspark.sql import functions as F
from test_termtiles import shuffled

from wakeline.operators import positions
from wakeline.operators.recall import keyword_top
from wakeline.sources import scratch
from wakeline.sources.scratch import written

def one():
    return F.lit(0)



def test_row_counts_equal_postings(spark):
    texts = ["the red garden red garden", "garden red", "Red-garden; a b", "", None, "red red red garden", "a red\ngarden b a"]
    df = spark.createDataFrame([(k, t, texts[-1 - k]) for k, t in enumerate(texts)], "doc_id long, text string, title string")
    q = spark.createDataFrame([(1, "the red garden"), (2, "a b garden red"), (3, "nothing")], "query_id long, text string")
    asked = written(positions.asked_terms(q, "text", one()), "asked")
    columns = ("title", "text")
    held = written(positions.postings(df, one(), "doc_id", columns, positions.wanted_terms(asked)), "postings")
    count = lambda c: Counter((r.a, r.b, r.key, r.tf, r.dl) for r in c.collect())
    assert count(positions.row_counts(df, asked, one(), "doc_id", columns)) == count(positions.among_asked(positions.term_counts(held, asked), asked))


def test_keys_that_come_again(spark):
    """They count as one text, as postings do; the others are counted in their rows."""
    rows = [(1, "red garden here"), (1, "red garden here"), (2, "red garden red garden"), (None, "garden red"), (None, "garden"), (3, "wall and stone"), (4, "stone"), (5, "sand")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = written(positions.asked_terms(spark.createDataFrame([(1, "red garden"), (2, "stone garden")], "query_id long, text string"), "text", one()), "asked")
    held = written(positions.postings(df, one(), "doc_id", ("text",), positions.wanted_terms(asked)), "postings")
    want = positions.keyword_search(held, written(positions.sizes(df, one(), ("text",)), "sizes"), asked, 3)
    got = positions.search(df, asked, one(), "doc_id", 3, ("text",))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 6


def test_no_place_is_shuffled(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("red garden " * 50).alias("text"))
    q = spark.createDataFrame([(1, "red garden")], "query_id long, text string")
    rows, n = shuffled(spark, lambda: positions.search(docs, positions.asked_terms(q, "text", one()), one(), "doc_id", 2, ("text",)))
    assert len(rows) == 2 and n < 300 * 12


def test_unasked_words_stay(spark, monkeypatch):
    """Words that nobody asked for aren't shuffled where there are more asked ones than are broadcast."""
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 2)
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("alder birch cedar"), F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.concat(F.lit("w"), k.cast("string")))).alias("text"))
    q = spark.createDataFrame([(1, "alder birch cedar elder")], "query_id long, text string")
    rows, n = shuffled(spark, lambda: keyword_top(docs, q, 2))
    assert len(rows) == 2 and n < 100 * 20
