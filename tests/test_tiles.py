"""Tiles against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import tiles


def made(seed, n, ties):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 6))
    v /= np.sqrt((v**2).sum(axis=1, keepdims=True))
    if ties:
        v = v[rng.integers(0, 12, n)]
    owner = np.where(rng.random(n) < 0.5, 1, rng.integers(2, 6, n))  # one owner has half of all rows
    return [(k, int(owner[k]), int(rng.integers(0, 1000)), [float(x) for x in v[k]]) for k in range(n)]


def brute(questions, rows, most, low, high, least, earlier, by_key):
    out = set()
    for q, own, now, v in questions:
        if not v:
            continue
        got = []
        for k, o, t, w in rows:
            if o == own and w is not None and len(w) == len(v) and (low is None or t >= now - low) and (high is None or t <= now - high) and (not earlier or k < q):
                s = round(float(np.dot(v, w)), 6)
                if least is None or s >= least:
                    got.append((k, k, s) if by_key else (-s, k, s))
        out |= {(q, k, round(s, 5)) for _, k, s in sorted(got)[:most]}
    return out


@pytest.mark.parametrize("block, ties", [(16_384, False), (40, False), (40, True)])
@pytest.mark.parametrize("most, low, high, least, earlier, by_key", [(3, None, None, None, False, False), (4, 600, 50, 0.3, False, False), (1, None, 100, 0.2, True, True)])
def test_equals_all_pairs(spark, monkeypatch, block, ties, most, low, high, least, earlier, by_key):
    monkeypatch.setattr(tiles, "BLOCK", block)
    monkeypatch.setattr(tiles, "STRIP", 16)
    rows = made(1, 300, ties) + [(900, 1, 0, None), (901, 1, 0, [1.0, 0.0]), (902, 1, 0, [])]
    q = spark.createDataFrame(rows, "query_id long, owner long, now long, v array<double>")
    r = spark.createDataFrame(rows, "key long, owner long, t long, v array<double>")
    spans = None if low is None and high is None else [(None if low is None else F.col("now") - low, F.col("now") - high)]
    got = {(x.query_id, x.key, round(x.score, 5)) for x in tiles.vector_search(q, r, most, spans=spans, least=least, earlier=earlier, by_key=by_key).collect()}
    assert got == brute(rows, rows, most, low, high, least, earlier, by_key)


def test_bounds_save_products(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 32))
    x = (centres[np.repeat(np.arange(8), 1024)] + 0.05 * rng.normal(size=(8192, 32)))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    every = [(np.full(64, tiles._LOW), np.full(64, tiles._HIGH))]
    i, keys, score, products = tiles.search_tile(x[::128], every, None, np.arange(8192), np.zeros(8192, dtype=np.int64), x, 5, 0.8, False)
    assert products < 0.6 * 64 * 8192
    want = np.sort(np.round(x[::128] @ x.T, 6), axis=1)[:, -5:]
    assert np.allclose(np.sort(score.reshape(64, 5), axis=1), want)


def test_empty(spark):
    q = spark.createDataFrame([], "query_id long, owner long, v array<double>")
    assert tiles.vector_search(q, spark.createDataFrame([], "key long, owner long, t long, v array<double>"), 3).collect() == []
