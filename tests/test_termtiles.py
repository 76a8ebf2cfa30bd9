"""Tiles of weighed terms: equal to brute force over blocks, spans and ties; searches shuffle postings, never pairs of a question and a row."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import positions, retrieval, termtiles
from wakeline.operators.places import trigram_top
from wakeline.operators.recall import keyword_top
from wakeline.sources.scratch import written

WORDS = ["alder", "birch", "cedar", "elder", "maple"]


@pytest.mark.parametrize("blocks", [(100, 100), (3, 4)])
def test_tiles_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(termtiles, "QUESTIONS", blocks[0])
    monkeypatch.setattr(termtiles, "ROWS", blocks[1])
    rng, terms = random.Random(3), "abcdef"
    held = [(o, t, k, rng.choice([0.5, 1.0]), k % 7) for o in (1, 2) for k in range(o * 20, o * 20 + 15) for t in rng.sample(terms, 3)]
    asked = [(q, q % 3, t, rng.choice([0.25, 1.0]), None if q % 4 == 0 else q % 5, None if q % 2 else q % 5 + 2) for q in range(12) for t in rng.sample(terms + "z", 3)]
    size = written(spark.createDataFrame([(1, 15), (2, 15)], "owner long, n_docs long"), "size")
    got = termtiles.term_search(spark.createDataFrame(asked, "query_id long, owner long, term string, w double, low long, high long"), spark.createDataFrame(held, "owner long, term string, key long, w double, t long"), size, 2)
    got = {(r.query_id, r.key): r.score for r in got.collect()}
    for q, rows in itertools.groupby(asked, lambda r: r[0]):
        rows, sums = list(rows), {}
        for (_, o, t, w, low, high), (ho, ht, k, hw, at) in itertools.product(rows, held):
            if o == ho and t == ht and (low is None or at >= low) and (high is None or at <= high):
                sums[k] = sums.get(k, 0.0) + w * hw
        best = sorted(sums, key=lambda k: (-sums[k], k))[:2]
        assert sorted((k for i, k in got if i == q), key=lambda k: (-got[q, k], k))[:2] == best
        assert all(got[q, k] == pytest.approx(sums[k], abs=1e-5) for k in best)


def shuffled(spark, df):
    """Rows of a query's shuffles."""
    def written_rows():
        gateway = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written_rows()
    rows = df().collect()
    return rows, written_rows() - before


SEARCHES = {
    "keyword_top": lambda docs, q: keyword_top(docs, q, 2),
    "trigram_top": lambda docs, q: trigram_top(docs, q, 2),
    "positions": lambda docs, q: positions.search(docs, positions.asked_terms(q, "text", F.lit(0)), F.lit(0), "doc_id", 2, ("text",)),
    "bm25": lambda docs, q: retrieval.bm25(q.select("query_id", F.lit(0).alias("user_id"), F.explode(F.array_distinct(retrieval.pieces("text"))).alias("term")), docs.select(F.lit(0).alias("user_id"), F.col("doc_id").alias("capture_id"), retrieval.pieces("text").alias("terms")), most=2),
}


@pytest.mark.parametrize("name", SEARCHES)
def test_no_pairs_are_shuffled(spark, name):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(" ".join(WORDS)).alias("text"))
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.lit(" ".join(WORDS)).alias("text"))
    rows, n = shuffled(spark, lambda: SEARCHES[name](docs, asked))
    assert len(rows) == 400 and {r.rank for r in rows} == {1, 2}
    assert n < 200 * 400
