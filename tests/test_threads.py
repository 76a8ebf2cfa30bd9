"""Golden rows for open threads, salient lines and document identities."""

import datetime as dt

from wakeline.operators.threads import document_identity, line_identities, open_threads, salient_lines

DAY = dt.date(2024, 3, 10)


def night(back, text, user=1):
    return (user, DAY - dt.timedelta(days=back), text)


def test_open_threads(spark):
    rows = [
        night(0, "Reply to the landlord about deposit"), night(1, "landlord deposit still unanswered"), night(3, "deposit: landlord replied"), night(4, "something other entirely"), night(5, "landlord deposit"),
        night(0, "Book dentist appointment"), night(3, "Book dentist appointment"), night(0, None), night(0, "Fix printer driver", 2),
    ]
    schema = "user_id int, day date, text string"
    df = spark.createDataFrame(rows, schema)
    got = {(r.user_id, r.text): (r.nights, r.days_open, r["rank"]) for r in open_threads(df).collect()}
    assert got == {(1, "Reply to the landlord about deposit"): (3, 4, 1), (1, "Book dentist appointment"): (1, 1, 2), (2, "Fix printer driver"): (1, 1, 1)}
    gone = spark.createDataFrame([(1, "dentist appointment")], "user_id int, text string")
    assert len(open_threads(df, gone).collect()) == 2
    assert open_threads(spark.createDataFrame([], schema)).isEmpty()


def test_salient_lines(spark):
    long = "the quarterly budget review moved to another building"
    text = f"short\nhttp://example.com/a/very/long/link\n{long}\n{long} today\n• bullets are dropped from this list\na plain line of some words\n" + "x" * 200
    df = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(salient_lines()).collect()] == [[long, "a plain line of some words"], [], None]


def test_identities(spark):
    rows = [("mail a@x.edu and b@y.edu", "school"), ("a@x.edu and b@gmail.com", None), ("invoice and contract for a campus", "work"), ("invoice for a campus", None), ("My resume a@x.edu", None), ("", None), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "text string")
    assert [r[0] for r in df.select(document_identity()).collect()] == [w for _, w in rows]
    docs = spark.createDataFrame([(1, "home b@gmail.com\n\nschool a@x.edu\nplain"), (2, "a@x.edu"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.line, r.identity) for r in line_identities(docs).collect()] == [(1, "home b@gmail.com", "personal"), (1, "school a@x.edu", "school")]
