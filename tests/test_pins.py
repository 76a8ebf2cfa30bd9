"""Equal vectors of a user's questions and pins are compared once."""

from datetime import datetime, timedelta

from wakeline.operators import cards, memory

LOG = "query_id long, user_id long, text string, ts timestamp_ntz, embedding array<float>"


def log(spark):
    rows = [(k, k % 2, "where is my book", datetime(2024, 1, 1) + timedelta(hours=k), [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.0, 0.0]][k // 2 % 4]) for k in range(64)]
    return spark.createDataFrame(rows, LOG)


def test_pins(spark, monkeypatch):
    met = []
    search = cards.vector_search
    monkeypatch.setattr(cards, "vector_search", lambda q, p, *a, **k: met.append((q.count(), p.count())) or search(q, p, *a, **k))
    df = log(spark)
    got = cards.pinned_answers(df, df.selectExpr("query_id AS pin_id", "user_id", "embedding"))
    assert {(r.query_id, r.pin_id, r.score) for r in got.collect()} == {(k, k % 2 + 2 * (k // 2 % 4), 1.0) for k in range(64) if k // 2 % 4 < 3}
    assert met == [(6, 6)]


def test_candidates(spark):
    got = memory.pin_candidates(log(spark))
    assert {(r.query_id, r.asks) for r in got.collect()} == {(k, 8 if k // 2 % 4 == 2 else 16) for k in range(64) if k // 2 % 4 < 3}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 3  # both sides are made distinct before they meet
