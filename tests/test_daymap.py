"""Golden rows of a day's map."""

from datetime import datetime, timedelta

from wakeline.operators.daymap import day_maps
from wakeline.operators.sessions import with_dwell

T0 = datetime(2024, 1, 3, 9)
SCHEMA = "capture_id long, user_id long, ts timestamp_ntz, app string, window_title string, url string, page_key string, embedding array<double>"


def test_day_map(spark):
    walk = [("a", 0), ("a", 3), ("b", 5), ("a", 8), ("b", 10), ("c", 12), ("a", 13)]
    title = {"a": "(2) Budget of the school", "b": "Notes on tomatoes", "c": "Quick look"}
    vector = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.9, 0.1]}
    rows = [(k, 1, T0 + timedelta(minutes=m), "Mail", title[p], None if p == "b" else f"https://x.y/{p}", p, vector[p]) for k, (p, m) in enumerate(walk)]
    rows += [(100, 2, T0, "Mail", None, None, "only", None)]
    got = {r.user_id: r for r in day_maps(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    one = got[1]
    # dwell: a 3 + 2 + 2 (to the next capture, 5 minutes at most), b 3 + 2, c 1
    assert [(n.id, n.page_key, n.minutes, n.visits, n.capture_id) for n in one.nodes] == [(0, "a", 7.0, 4, 0), (1, "b", 5.0, 2, 2), (2, "c", 1.0, 1, 5)]
    assert [n.label for n in one.nodes] == ["Budget of the school", "Notes on tomatoes", "Quick look"] and [n.url for n in one.nodes] == ["https://x.y/a", None, "https://x.y/c"]
    assert one.nodes[0].cluster == one.nodes[2].cluster != one.nodes[1].cluster
    assert [(e.a, e.b, e.weight) for e in one.edges] == [(0, 1, 3)] and [s.node for s in one.trace] == [0, 1, 0, 1, 2, 0]
    assert (one.captures, one.pages, one.minutes) == (7, 3, 13)
    two = got[2]  # a day of one capture, without a vector
    assert [(n.page_key, n.minutes, n.cluster) for n in two.nodes] == [("only", 0.0, None)] and two.edges == [] and len(two.trace) == 1


def test_the_last_capture_of_a_day_earns_nothing(spark):
    rows = [(1, 1, T0), (2, 1, T0 + timedelta(seconds=100)), (3, 1, T0 + timedelta(seconds=1000)), (4, 1, T0 + timedelta(days=1)), (5, 2, T0)]
    df = spark.createDataFrame(rows, "capture_id long, user_id long, ts timestamp_ntz")
    assert {r.capture_id: r.dwell for r in with_dwell(df).collect()} == {1: 100, 2: 300, 3: 0, 4: 0, 5: 0}
