"""Searches that only count: equal to brute force over blocks, ties, repeated and null ids; a document is a row of a shuffle, not one for each of its pieces."""

import random
import re
from collections import Counter

import pytest
from test_termtiles import shuffled

from wakeline.operators import termtiles
from wakeline.operators.places import trigram_top


def pieces(text):
    return {w[i : i + 3] for w in re.findall("[a-z0-9]+", (text or "").lower()) for i in range(len(w) - 2)}


def brute(docs, asked, most):
    out = set()
    n = {}
    for q, text in asked:
        words = [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) >= 3][:12]
        own = pieces(" ".join(words))
        n.setdefault(q, len(own))
        for d, t in docs:
            if k := len(own & pieces(t)):
                n[q, d] = n.get((q, d), 0) + k
    for q, _ in asked:
        hits = sorted((-n[q, d], d is not None, d or 0) for d in {d for d, _ in docs} if (q, d) in n)[:most]
        out |= {(q, d if known else None, r, round(-k / n[q], 6)) for r, (k, known, d) in enumerate(hits, 1)}
    return out


@pytest.mark.parametrize("blocks", [(100, 1000, 64), (5, 40, 3)])
@pytest.mark.parametrize("odd", [False, True])
def test_counts_equal_brute_force(spark, monkeypatch, blocks, odd):
    for name, value in zip(("COUNTED", "ROWS", "AT_ONCE"), blocks, strict=True):
        monkeypatch.setattr(termtiles, name, value)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abé1Z ") for _ in range(rng.randrange(2, 9)))
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 40)))) for k in range(150)] + [(200, None), (201, ""), (202, "ab"), (203, "Ünd ABAé")]
    asked = [(q, " ".join(word() for _ in range(rng.randrange(1, 20)))) for q in range(12)] + [(50, None), (51, "a b"), (52, "aba " * 30)]
    if odd:
        docs, asked = docs + docs[:9] + [(None, "aba abb"), (None, "aba bba")], asked + asked[:2]
    got = trigram_top(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string"), 4).collect()
    assert Counter((r.query_id, r.doc_id, r["rank"], r.score) for r in got) == Counter(brute(docs, asked, 4))


def test_a_document_is_one_shuffled_row(spark):
    docs = spark.createDataFrame([(k, "alder birch cedar elder maple") for k in range(400)], "doc_id long, text string")
    asked = spark.createDataFrame([(k, "alder birch cedar elder maple") for k in range(200)], "query_id long, text string")
    rows, n = shuffled(spark, lambda: trigram_top(docs, asked, 2))
    assert len(rows) == 400 and n <= 400 + 200 + 400 + 10
