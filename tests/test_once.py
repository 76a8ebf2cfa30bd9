"""Texts are read once a document, however many captures share it, and only for the captures that need them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wakeline import registry
from wakeline.operators import episodes
from wakeline.operators.memory import vague_day, vague_due, vague_kind
from wakeline.operators.text import distinct_lines
from wakeline.sources.captures import captures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, pattern", [("screen_triggers", "traceback"), ("vague_deadlines", "cob|end of"), ("enriched_captures", "[card]")])
def test_patterns_meet_documents_before_captures(spark, name, pattern):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join " in plan and pattern in plan[plan.index("Join ") :]


def test_kinds_of_a_text_are_those_of_its_lines(spark):
    lines = ["by end of", "day", "EOD", "tomorrow", "end of the week", "next week", "next", "week", "next month", "nothing", None]
    df = spark.createDataFrame([(a, b, datetime(2024, 1, d)) for a in lines for b in lines for d in (3, 6, 31)], "a string, b string, ts timestamp_ntz")
    both = df.withColumn("text", F.concat_ws("\n", "a", "b"))
    assert both.where(~vague_due("text", "ts").eqNullSafe(vague_day(F.least(vague_kind(F.col("a")), vague_kind(F.col("b"))), "ts"))).count() == 0


def test_distinct_lines(spark):
    """Lines are told apart inside their row, those of one id together; only the ids are shuffled where none comes again."""
    rows = [(1, "The same old line\nshort\nTHE SAME, old line!\nshort\nanother line here"), (2, ""), (3, None), (None, "a line of no id\nA line of no id."), (4, "one line of four\nx"), (4, "ONE line of four\nx\nmore of the four")]
    got = {r.doc_id: r.text for r in distinct_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "The same old line\nshort\nshort\nanother line here", 2: "", None: "a line of no id", 4: "ONE line of four\nx\nx\nmore of the four"}
    assert "posexplode" not in distinct_lines(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_few_captures_are_joined(spark):
    """Captures that are not asked for go before a text is joined to them."""
    every = captures(spark, SF, text=True)
    ids = every.select("capture_id").where("capture_id % 100 = 3")
    some = captures(spark, SF, text=True, only=ids)
    assert "LeftSemi" in some._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.where("capture_id % 100 = 3").collect()))


def test_names_of_a_long_text_are_counted_once(spark):
    names = [f"Name{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}" for k in range(1000)]
    text = ". ".join(names * 3 + [names[7], names[900], names[7]])
    df = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(episodes.entities(F.col("text")).alias("e"))
    assert [r.e for r in df.collect()] == [[names[7], names[900], *names[:6]], [], None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
