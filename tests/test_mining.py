"""Golden rows: commitments, labelled numbers, line diffs, limits of alerts, time phrases in a zone, diversity and cues, names, bundles."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeline.operators import alerts, commitments, diffs, episodes, retrieval, timewords

T0 = datetime(2024, 1, 3, 12)  # a Wednesday
NOTE = "capture_id long, user_id long, ts timestamp_ntz, app string, url string, page_key string, body string"


def found(spark, text, app="Mail", url=None):
    df = spark.createDataFrame([(1, 1, T0, app, url, "k", text)], NOTE)
    return [(r.who, r.what, r.due, r.confidence) for r in commitments.commitments(df).orderBy("at").collect()]


@pytest.mark.parametrize("text, want", [
    ("I'll send the report to Dana by Friday", [("me", "I'll send the report to Dana by Friday", None, 0.95)]),
    ("make sure to review the budget draft by end of day", [("them", "make sure to review the budget draft by end of day", date(2024, 1, 3), 0.85)]), ("can you review the budget draft by end of day", []),
    ("please share the slides next week", [("them", "please share the slides next week", None, 0.75)]),
    ("have to update the form once more", []), ("have to update the form tomorrow", [("me", "have to update the form tomorrow", date(2024, 1, 4), 0.85)]),
    ("Send the invoice today", [("me", "Send the invoice today", date(2024, 1, 3), 0.75)]),
    ("Send the invoice over", []), ("will you send the report by Friday?", []), ("I might send you the photos tonight", []), ("I won't pay the bill today", []), ("Get instant discounts on hotels today", []),
    ("remember to submit your form today", []), ("> I'll send the report to Dana by Friday", []), ("I'll send it", []), (None, []), ("", []),
    ("I'll call the bank tomorrow\nI'll call the bank tomorrow morning", [("me", "I'll call the bank tomorrow", date(2024, 1, 4), 0.85)]),
])
def test_commitments(spark, text, want):
    assert found(spark, text) == want


def test_patterns_meet_few_sentences(spark):
    """Of long texts without an opener or an order nothing is split; a plan that puts each pattern into every filter again took minutes."""
    filler = "\n".join(["Thtion be, esaned that thntwhre and wh orha be ansh thhaat stinst in thstnd"] * 20)
    texts = [filler, filler + "\nI'll send the report to Dana by Friday", filler + "\nSEND the invoice today", filler + "\nsend it\ntoday it is", None]
    df = spark.createDataFrame([(k, 1, T0, "Mail", None, "k", t) for k, t in enumerate(texts)], NOTE)
    assert [r[0] for r in df.select(commitments.may_promise(F.col("body"))).collect()] == [False, True, True, False, None]
    out = commitments.commitments(df)
    assert sorted(r.capture_id for r in out.collect()) == [1, 2]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("make sure to") <= 8


def test_trust_decides(spark):
    assert found(spark, "I'll send the report to Dana by Friday", "Terminal") == []
    assert found(spark, "I'll send the report to Dana by Friday", "Browser", "https://chatgpt.com/x") == []
    assert found(spark, "I'll send the report to Dana by Friday", "Browser", "https://a.b/") == [("me", "I'll send the report to Dana by Friday", None, 0.8)]
    assert found(spark, "I'll send the report to Dana by Friday", "Browser", "https://mail.google.com/x")[0][3] == 0.95


def test_repeats_of_a_fortnight_are_dropped(spark):
    rows = [(k, 1, T0 + timedelta(days=d), "Mail", None, "k", t) for k, (d, t) in enumerate([(0, "I'll send the report to Dana by Friday"), (2, "I'll send the report to Dama by Friday"), (3, "I'll call the bank tomorrow"), (17, "I'll send the report to Dana by Friday")])]
    rows.append((9, 2, T0, "Mail", None, "k", "I'll call the bank tomorrow"))
    new = commitments.new_commitments(commitments.storable(commitments.commitments(spark.createDataFrame(rows, NOTE))))
    assert sorted(r.capture_id for r in new.collect()) == [0, 2, 3, 9]


def numbers(spark, text):
    rows = commitments.labelled_numbers(spark.createDataFrame([(1, 1, T0, "a", None, "page", text)], NOTE)).orderBy("at").collect()
    return [(r.label, r.value, r.unit) for r in rows]


def test_numbers(spark):
    assert numbers(spark, "Weight 154.2 lbs\nMy resting heart rate: 61\nGrade 92%\nSleep 7 hrs") == [("weight", 154.2, "lbs"), ("heart rate", 61.0, ""), ("grade", 92.0, "%"), ("sleep", 7.0, "hrs")]
    assert numbers(spark, "Up to $20\nPhone 555\nScore: 0%\nGrade 2024\nSteps 12345678\nVersion 3\nviews 12\nChapter 9\n" + "x" * 130 + " weight 3") == []
    assert numbers(spark, "Steps 1,204 and weight 80 kg\nweight 81 kg") == [("steps", 1204.0, ""), ("weight", 81.0, "kg")]


def test_numbers_stored(spark):
    rows = [(k, 1, "page", T0 + timedelta(hours=h), 0, "weight", v, u) for k, (h, v, u) in enumerate([(0, 80.0, "kg"), (5, 80.0, "kg"), (6, 81.0, ""), (7, 20.0, "%"), (40, 80.0, "kg"), (41, 82.0, "kg")])]
    rows.append((9, 1, "https://www.youtube.com/x", T0, 0, "weight", 1.0, "kg"))
    # another user's page of the same key has its own unit and values, and a capture gives eight numbers
    rows += [(10, 2, "page", T0 + timedelta(hours=1), 0, "weight", 80.0, "%"), (11, 2, "page", T0 + timedelta(hours=2), 0, "weight", 80.0, "%"), (12, 2, "page", T0 + timedelta(hours=3), 0, "weight", 81.0, "kg"), (13, 2, None, T0, 0, "weight", 5.0, "")]
    rows += [(20, 3, "page", T0, k, f"label {k}", 1.0, "") for k in range(10)]
    kept = commitments.stored_numbers(spark.createDataFrame(rows, "capture_id long, user_id long, page_key string, ts timestamp_ntz, at int, label string, value double, unit string"))
    assert sorted(r.capture_id for r in kept.collect()) == [0, 2, 4, 5, 10] + [20] * 8


def test_kept_promises(spark):
    made = commitments.storable(commitments.commitments(spark.createDataFrame([(1, 1, T0, "Mail", None, "k", "I'll send the quarterly report to Dana by Friday")], NOTE)))
    later = [(2, 1, T0 + timedelta(days=1), "Mail", None, "k", "sent the quarterly report"), (3, 1, T0 + timedelta(days=2), "Mail", None, "k", "sent the quarterly report"), (4, 1, T0 - timedelta(days=1), "Mail", None, "k", "sent the quarterly report"), (5, 2, T0 + timedelta(days=1), "Mail", None, "k", "sent the quarterly report"), (6, 1, T0 + timedelta(hours=1), "Browser", "http://a", "k", "sent the quarterly report"), (7, 1, T0 + timedelta(hours=1), "Mail", None, "k", "the quarterly report")]
    assert [(r.capture_id, r.closed_at) for r in commitments.kept_promises(made, spark.createDataFrame(later, NOTE)).collect()] == [(1, T0 + timedelta(days=1))]


@pytest.mark.parametrize("old, new, added, removed, changed", [
    (["the quick brown fox", "second line here"], ["the qulck brovn fox", "second line here"], [], [], []),
    (["the quick brown fox"], ["the quick red fox"], [], [], [("the quick brown fox", "the quick red fox")]),
    (["price is $20 now"], ["price is $25 now"], [], [], [("price is $20 now", "price is $25 now")]),
    (["alpha beta gamma"], ["nothing alike 123", "alpha beta gamma"], ["nothing alike 123"], [], []),
    (["alpha beta gamma", "to be removed 9"], ["alpha beta gamma"], [], ["to be removed 9"], []), ([], ["new"], ["new"], [], []), (["same", "same"], ["same"], [], ["same"], []),
])
def test_diff_lines(old, new, added, removed, changed):
    assert diffs.diff_lines(old, new) == {"added": added, "removed": removed, "changed": [{"old": a, "new": b} for a, b in changed]}


def test_page_diffs(spark):
    rows = [(1, "12:30\nfirst line of it\nprice is $20 now", "12:45\nfirst line of it\nprice is $25 now\nfresh words here"), (2, None, None), (3, "a line that stays", "a line that stays")]
    d = diffs.page_diffs(spark.createDataFrame(rows, "k int, old string, new string")).select("k", "added", diffs.headline().alias("h"), F.round(diffs.changed_fraction(), 3).alias("f")).orderBy("k").collect()
    assert [tuple(r) for r in d] == [(1, ["fresh words here"], "This page changed: 1 added, 1 changed.", 0.667), (2, [], "Nothing changed on this page.", 0.0), (3, [], "Nothing changed on this page.", 0.0)]


def test_alert_limits(spark):
    hours = [(0, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "d"), (25, "d"), (47, "a"), (49, "a")]
    rows = [(1, k, T0 + timedelta(hours=h), t) for k, (h, t) in enumerate(hours)]
    assert sorted(r.capture_id for r in alerts.limited(spark.createDataFrame(rows, "user_id long, capture_id long, ts timestamp_ntz, topic string")).collect()) == [0, 2, 3, 5, 7]


def test_emit_and_frames(spark):
    rows = [(1, k, T0 + timedelta(seconds=s), a, u) for k, (s, a, u) in enumerate([(0, "x", None), (5, "x", None), (21, "x", None), (22, "y", None), (23, "y", "u"), (30, "y", "u")])]
    assert sorted(r.capture_id for r in alerts.worth_emitting(spark.createDataFrame(rows, "user_id long, capture_id long, ts timestamp_ntz, app string, url string")).collect()) == [0, 2, 3, 4]
    base = [10] * 100
    frames = [base, base[:96] + [50] * 4, base[:95] + [50] * 5, base[:95] + [50] * 5, None, base, [1]]
    rows = [(1, k, T0 + timedelta(seconds=k), f) for k, f in enumerate(frames)]
    assert sorted(r.capture_id for r in alerts.distinct_frames(spark.createDataFrame(rows, "user_id long, capture_id long, ts timestamp_ntz, frame array<int>")).collect()) == [0, 2, 4, 5, 6]


def test_time_phrases_in_a_zone(spark):
    rows = [(1, "what did I read Yesterday  morning", T0), (2, "last wednesday", T0), (3, "the past 2 hours", T0), (4, None, T0), (5, "no time here", T0), (6, "on wednesday", datetime(2024, 1, 4, 3))]
    got = {r.query_id: (r.since, r.until, r.rest) for r in timewords.with_window(spark.createDataFrame(rows, "query_id int, question string, ts timestamp_ntz"), "America/New_York").collect()}
    assert got[1] == (datetime(2024, 1, 2, 10), datetime(2024, 1, 2, 17), "what did I read")
    assert got[2] == (datetime(2023, 12, 27, 5), datetime(2023, 12, 28, 4, 59, 59), "")
    assert got[3] == (T0 - timedelta(hours=2), T0, "the") and got[4] == (None, None, None) and got[5] == (None, None, "no time here")
    assert got[6][0] == datetime(2024, 1, 3, 5)  # still Wednesday there


def test_time_phrases_beyond_the_calendar(spark):
    rows = [(1, "last 4000 weeks", T0), (2, "what was 99999999 days ago", T0), (3, "last 99999999999 days", T0), (4, "past 99999999999999999999 hours", T0), (5, "1 day ago", T0), (6, "past 9000000 weeks", T0)]
    got = {r.query_id: (r.since, r.until) for r in timewords.with_window(spark.createDataFrame(rows, "query_id int, question string, ts timestamp_ntz")).collect()}
    assert got[1] == (T0 - timedelta(weeks=4000), T0) and got[2] == (None, None)
    assert got[3] == got[4] == got[6] == (None, T0)
    assert got[5] == (datetime(2024, 1, 2), datetime(2024, 1, 2, 23, 59, 59))


def test_diverse_and_cued(spark):
    hits = [(1, k, k, a, s) for k, (a, s) in enumerate([("x", "the same head of a text that goes on and on for long"), ("x", "The same  head of a text that goes on and on for LONG, then some"), ("y", "the same head of a text that goes on and on for long"), ("x", "other"), ("x", "another thing with other in it"), ("x", None), ("z", "last")], 1)]
    df = spark.createDataFrame(hits, "query_id long, capture_id long, rank int, app string, snippet string")
    assert [r.capture_id for r in retrieval.diverse(df, 10).orderBy("rank").collect()] == [1, 3, 4, 6, 7]
    assert [r.capture_id for r in retrieval.diverse(df, 2).orderBy("rank").collect()] == [1, 3]
    cued = df.withColumn("cue", F.lit("x"))
    assert [r.capture_id for r in retrieval.cue_first(cued).orderBy("rank").collect()] == [1, 2, 4, 5, 6, 3, 7]
    assert [r.capture_id for r in retrieval.cue_first(df.withColumn("cue", F.lit("z"))).orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6, 7]


def test_entities_and_vectors(spark):
    df = spark.createDataFrame([("Ada Lovelace met Bob. Ada Lovelace and IBM; Bob, the The",), ("",), (None,)], "text string")
    got = df.select(episodes.entities(F.col("text")).alias("e"), episodes.hashed_vector("text").alias("v")).collect()
    assert got[0].e == ["Ada Lovelace", "Bob", "IBM"] and abs(sum(x * x for x in got[0].v) - 1) < 1e-9
    assert got[1].e == [] and got[1].v is None and got[2].v is None
