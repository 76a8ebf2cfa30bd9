"""Golden records of two engines' log, read from JSON lines, and their verdict."""

import json

import pytest

from wakeline.operators import readings
from wakeline.sources.sinks import read_log

BASE = {"app": "Mail", "a_chars": 1000, "b_chars": 1000, "a_lines": 40, "b_lines": 40, "a_doubled": 2, "b_doubled": 0, "a_ms": 400, "b_ms": 100, "overlap": 0.95, "b_ok": True}


def judged(spark, path, *records):
    (path / "log").write_text("\n".join([*(json.dumps(BASE | r) for r in records), "not json"]) + "\n")
    (row,) = readings.verdicts(read_log(spark, str(path / "log"), readings.LOG)).collect()
    return row


@pytest.mark.parametrize("change, verdict, reasons", [
    ({}, "switch", ["faster", "doubles less"]), ({"b_chars": 700}, "keep", ["faster", "doubles less", "reads less"]), ({"overlap": 0.55}, "keep", ["faster", "doubles less", "reads other words"]),
    ({"b_ms": 400, "b_doubled": 2}, "no gain", []), ({"b_doubled": 9}, "keep", ["faster", "doubles more"]), ({"b_ok": False}, "never answered", []), ({"b_ok": None}, "never answered", []), ({"b_ms": 370, "b_doubled": 1}, "switch", ["doubles less"]),
])
def test_verdict(spark, tmp_path, change, verdict, reasons):
    row = judged(spark, tmp_path, *[change] * 120)
    assert (row.verdict, row.reasons, row.records, row.thin) == (verdict, reasons, 120, verdict == "never answered")


def test_failed_runs_are_not_in_the_means(spark, tmp_path):
    row = judged(spark, tmp_path, *[{}] * 11, {"b_ok": False, "b_chars": 0, "b_ms": None})
    assert (row.records, row.comparable, row.failed, row.b_chars, row.verdict, row.thin) == (12, 11, 1, 1000.0, "switch", True)


def test_disagreements(spark):
    rows = [("x", 100, 69, 1, 0, 0.6, True), ("y", 100, 10, 1, 2, 0.1, True), ("y", 100, 20, 1, 1, 0.2, True), ("z", 100, 70, 1, 1, 0.7, True), (None, 100, 0, 1, 1, 0.0, True), ("x", 100, 0, 1, 0, 0.0, False), ("w", 100, 99, 1, 1, None, True)]
    log = spark.createDataFrame(rows, "app string, a_chars long, b_chars long, a_doubled long, b_doubled long, overlap double, b_ok boolean")
    (r,) = readings.disagreements(log).collect()
    assert (r.n, r.improved, r.worse, r.dropped, r.apps) == (6, 1, 1, 4, ["y", "", "x"])


def test_compared(spark):
    rows = [("one one two\n\n x", "two three"), (None, ""), ("same", "Same")]
    got = [(r.a_chars, r.b_chars, r.a_lines, r.b_lines, r.a_doubled, r.overlap) for r in readings.compared(spark.createDataFrame(rows, "a string, b string")).collect()]
    assert got == [(15, 9, 2, 1, 1, 0.25), (0, 0, 0, 0, 0, 1.0), (4, 4, 1, 1, 0, 1.0)]
