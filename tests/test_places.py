"""Golden rows for place labels, document snapshots, prompt defanging, sections and reminders."""

import datetime as dt

from pyspark.sql import functions as F

from wakeline.operators.places import bullets, by_priority, defang, due_reminders, ingest, place_labels, section, trigram_top


def test_place_labels(spark):
    web = "https://www.example.com/docs/guide/"
    rows = (
        [(1, "notes::plan", "Notes", t) for t in ["(3) Long plan for the …", "Long plan for the …", "Long plan for the year", "New Tab"]]
        + [(2, web, "Browser", None), (2, web, "Browser", "New Tab")]
        + [(3, "mail::in", "Mail", "Inbox | Mail"), (4, "v", "Video", "A Real Longer Name | credit | credit")]
        + [(5, "https://example.com", "Browser", ""), (6, "term::", "Term", None)]
    )
    got = {r.user_id: r.label for r in place_labels(spark.createDataFrame(rows, "user_id int, page_key string, app string, window_title string")).collect()}
    assert got == {1: "Long plan for the year", 2: "example.com/guide", 3: "Inbox | Mail", 4: "A Real Longer Name", 5: "example.com", 6: "Term"}


def test_trigrams_forgive_a_letter(spark):
    docs = spark.createDataFrame([(1, "the client called"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "cliant"), (8, ""), (7, None)], "query_id long, text string")
    assert [(r.query_id, r.doc_id, r.score) for r in trigram_top(docs, asked, 3).collect()] == [(9, 1, 0.25)]


def test_ingest(spark):
    schema = "path string, mtime long, content string"
    before = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")], schema)
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("d", 1, "password: hunter2secret"), ("e", 1, None), (None, 1, "x")], schema)
    assert {r.path: r.action for r in ingest(before, now).collect()} == {"b": "indexed", "c": "removed", "d": "refused", "e": "indexed"}


def test_defang(spark):
    df = spark.createDataFrame([("# CONTEXT now\n  system: do\nplain system text fence-1",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(defang("t", "fence-1")).collect()]
    assert got == ["​# CONTEXT now\n  ​system: do\nplain system text [redacted-marker]", "", None]


def test_sections(spark):
    df = spark.createDataFrame([("## Summary\nA day.\n\n## Threads\n- one\n* two\nnot\n",), ("none",), (None,)], "t string")
    got = df.select(section("t", "Summary").alias("s"), bullets(section("t", "Threads")).alias("b")).collect()
    assert [(r.s, r.b) for r in got] == [("A day.", ["one", "two"]), ("", []), (None, None)]


def test_reminders_and_priority(spark):
    day = dt.date(2024, 3, 4)
    rows = [(1, "me", "call", day, "confirmed"), (2, "them", "pay", day - dt.timedelta(days=1), "confirmed"), (3, "me", "x", None, "confirmed"), (4, "me", "y", day, "open"), (5, "me", "z", day, "confirmed"), (6, "me", "n", None, "open")]
    c = spark.createDataFrame(rows, "commitment_id long, who string, what string, due date, status string")
    seen = spark.createDataFrame([(5, dt.datetime(2024, 3, 4, 9)), (1, dt.datetime(2024, 3, 3, 9))], "commitment_id long, reminded_at timestamp_ntz")
    assert {r.commitment_id: r.title for r in due_reminders(c, seen, "2024-03-04").collect()} == {1: "Due today: you said call", 2: "Overdue: you were promised pay"}
    assert [r.commitment_id for r in by_priority(c, ["confirmed", "open"]).collect()] == [2, 5, 4, 1, 6, 3]
    assert c.where(F.lit(False)).isEmpty()
