"""Golden rows: the fixtures' users ask once each, so forgetting has no rows there."""

from wakeline.operators import recall


def test_forgetting_events(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    log = spark.createDataFrame(
        [
            (1, 1, "where is it", "2024-01-01 10:00:00", a),
            (2, 1, "who was that", "2024-01-01 10:02:00", a),  # two minutes later: asked in other words
            (3, 1, "when is it", "2024-01-01 12:00:00", a),  # hours later: neither
            (4, 1, "price", "2024-01-02 10:00:00", b),  # another topic
            (5, 1, "when is it", "2024-01-02 10:00:00", a),  # a day after the first
            (6, 2, "when is it", "2024-01-03 10:00:00", a),  # another user
            (7, 1, "when", "2024-01-03 10:00:00", None),
        ],
        "query_id long, user_id long, text string, ts string, embedding array<float>",
    ).selectExpr("query_id", "user_id", "text", "cast(ts AS timestamp_ntz) AS ts", "embedding")
    got = sorted(tuple(r) for r in recall.forgetting_events(log).select("query_id", "prior_id", "kind", "category", "gap_days").collect())
    assert got == [(2, 1, "rephrase", "name", 0.0), (5, 1, "re-ask", "date", 1.0)]
