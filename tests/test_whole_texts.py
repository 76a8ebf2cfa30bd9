"""Whole texts count: links, triggers and templates far behind the beginning of a text."""

from datetime import date, datetime, timedelta

import pytest

from wakeline import registry
from wakeline.operators import episodes, rescue

T0 = datetime(2024, 1, 31)
FAR = "word " * 2000


@pytest.fixture
def tables(spark, tmp_path):
    """An episode of captures 0, 3, 6 and 9 on documents 0 to 3, which hold ten links each, a trace and a meeting."""
    links = lambda d: " ".join(f"https://a.b/{d}/{k}" for k in range(10)) + f" https://a.b/{d}/3"
    texts = [links(0), links(1), f"{FAR}Traceback of a run", f"{FAR}see you on Zoom"]
    frames = {
        "events": ([(e, 0, T0 + timedelta(minutes=e), "signup") for e in (0, 3, 6, 9)], "event_id long, user_id long, ts timestamp_ntz, event_type string"),
        "pages": ([(0, "https://a.b/")], "page_id long, url string"),
        "documents": (list(enumerate(texts)), "doc_id long, text string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_all_links_of_an_episode(spark, tables):
    got = registry.queries()["episode_records"](spark, tables).collect()
    assert [x for r in got for x in r.links] == [f"https://a.b/{d}/{k}" for d in (0, 1) for k in range(10)]


def test_all_links_of_a_record(spark):
    rows = [(k, 1, 5, T0 + timedelta(minutes=k), "Mail", f"https://a.b/{k} https://a.b/{k + 1}") for k in range(12)]
    e = episodes.episodes(spark.createDataFrame(rows, "capture_id long, user_id long, session long, ts timestamp_ntz, app string, ocr_text string")).first()
    assert e.links == [f"https://a.b/{k}" for k in range(13)]


def test_triggers_of_whole_texts(spark, tables):
    got = {r.capture_id: (r.stack_trace, r.meeting) for r in registry.queries()["screen_triggers"](spark, tables).collect()}
    assert got == {0: (False, False), 3: (False, False), 6: (True, False), 9: (False, True)}


def test_templates_of_whole_texts(spark):
    screens = spark.createDataFrame([(1, f"{FAR}Traceback, in the meeting", [1.0], 1, date(2024, 1, 31))], "user_id long, ocr_text string, embedding array<double>, versions long, day date")
    log = spark.createDataFrame([], "query_id long, user_id long, text string, embedding array<double>, tapped boolean, ts timestamp_ntz")
    assert [r.text for r in rescue.suggestions(screens, log).orderBy("rank").collect()] == list(rescue.TEMPLATES[:2])
