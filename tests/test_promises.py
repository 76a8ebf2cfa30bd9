"""Promises of notes: texts are looked through once a document, and give what the whole notes give."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wakeline import registry
from wakeline.operators import commitments as C

SF = "/root/testdata/sf0.001"
TEXTS = (
    "I'll send the report to Dana by Friday", "Submit the tax form this week. Please call the bank by noon tomorrow", "  please reply to the landlord by tomorrow\nnothing here", "On Monday Bob wrote:\n> I need to call the bank about the loan", "", None,
    "- I will email the professor tonight - I have to pay the rent by Monday", "Thanks,\nneed to email the professor tonight", "\n\n  \nremember to book the flight by Friday!", "I need to call the bank about the loan",
)


@pytest.mark.parametrize("name", ["commitments", "commitments_new", "commitments_stored"])
def test_promises_are_looked_for_before_captures_meet(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "circle back" in plan[plan.index("Join ") :]


def test_notes_give_what_their_parts_give(spark):
    rows = [(10 * i + j, 1, datetime(2024, 1, 31), "Mail", None, a, b) for i, a in enumerate(TEXTS) if a for j, b in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "capture_id long, user_id long, ts timestamp_ntz, app string, url string, line string, ocr_text string").where("line NOT LIKE '%\n%'")
    whole = C.commitments(df.withColumn("body", F.concat_ws("\n", "line", "ocr_text")))
    parts = C.promised(df.withColumn("said", F.when(C.may_promise(F.col("ocr_text")), C.promising("ocr_text"))), C.of_notes("said"))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str) and whole.count() > 20
    assert whole.columns == parts.columns


def test_alike_phrases(spark):
    assert C._alike("send the report to dana", "send the report to dan") and C._alike("call bank", "call bank now")
    assert not C._alike("send the report to dana", "pay the rent by monday") and not C._alike("abcdef", "fedcba")
