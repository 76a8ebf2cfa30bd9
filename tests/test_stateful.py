"""Stateful streams equal their table jobs over shuffled micro-batches, across a restart from the checkpoint."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeline.operators import alerts, commitments
from wakeline.streaming import feeds, stateful

T0 = datetime(2024, 1, 3, 12)


def sec(seconds):
    return T0 + timedelta(seconds=seconds)


def run(spark, tmp_path, rows, schema, stream, end, files=4, late=timedelta(hours=6)):
    """The stream over rows in files of shuffled micro-batches, stopped in the middle and started again; a row far ahead moves the watermark past all."""
    rng = random.Random(7)
    ts = schema.split(", ").index("ts timestamp")
    rows = sorted(rows, key=lambda r: r[ts] + timedelta(seconds=rng.uniform(0, 0.9) * late.total_seconds()))  # out of order by less than the watermark
    size = -(-len(rows) // files)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[end]]
    out, mark, seen = str(tmp_path / "out"), str(tmp_path / "mark"), str(tmp_path / "in")
    for i, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(seen)
        if i % 2 or i == len(parts) - 1:  # every other time: a start from the checkpoint
            feeds.sweep(stream(feeds.read_feed(spark, seen, spark.createDataFrame([], schema).schema, files=1)), out, mark)
    return spark.read.parquet(out)


def same(stream, table):
    columns = sorted(table.columns)
    rows = lambda df: Counter(map(str, df.select(*(F.col(c).cast("string") for c in columns)).collect()))
    got, want = rows(stream), rows(table)
    assert got == want and got
    return got


def test_alert_limits(spark, tmp_path):
    rng = random.Random(1)
    schema = "user_id long, capture_id long, ts timestamp, topic string"
    rows = [(rng.randrange(3), k, sec(rng.randrange(8 * 86400)), rng.choice("abcdef")) for k in range(120)]
    got = run(spark, tmp_path, rows, schema, lambda f: stateful.limited_stream(f, "6 hours"), (9, 999, sec(40 * 86400), "z"))
    kept = same(got, alerts.limited(spark.createDataFrame(rows, schema)))
    assert len(kept) < 100


def test_new_commitments(spark, tmp_path):
    rng = random.Random(2)
    schema = "user_id long, capture_id long, ts timestamp, at int, what string"
    whats = ["I'll send the report to Dana", "I'll send the report to Dama", "I need to call the bank", "pay the gas bill", "I'll send the slides to Omar"]
    rows = [(rng.randrange(2), k, sec(rng.randrange(40 * 86400)), k % 3, rng.choice(whats)) for k in range(80)]
    got = run(spark, tmp_path, rows, schema, lambda f: stateful.new_commitments_stream(f, "6 hours"), (9, 999, sec(90 * 86400), 0, "z"))
    same(got, commitments.new_commitments(spark.createDataFrame(rows, schema)))


def test_stored_numbers(spark, tmp_path):
    rng = random.Random(3)
    schema = "user_id long, capture_id long, page_key string, ts timestamp, at int, label string, value double, unit string"
    rows = [(rng.randrange(2), k, "page", sec(rng.randrange(6 * 86400)), 0, rng.choice(["weight", "score"]), float(rng.randrange(4)), rng.choice(["kg", "", "%"])) for k in range(150)]
    got = run(spark, tmp_path, rows, schema, lambda f: stateful.stored_numbers_stream(f, "6 hours"), (9, 999, "page", sec(40 * 86400), 0, "weight", 1.0, ""))
    same(got, commitments.stored_numbers(spark.createDataFrame(rows, schema)))


OBSERVED = "user_id long, capture_id long, ts timestamp, app string, url string, frame array<int>"


def test_emissions(spark, tmp_path):
    rng = random.Random(4)
    frames = [[10] * 40, [10] * 39 + [90], [10] * 30 + [90] * 10, [200] * 40, None]
    rows, at = [], 0
    for k in range(120):
        at += rng.choice([1, 3, 8, 15, 22, 50, 700])
        rows.append((k % 2, k, sec(at), rng.choice("xxxy"), rng.choice([None, None, "u"]), rng.choice(frames)))
    end = (9, 999, sec(at + 7200), "z", None, None)
    got = run(spark, tmp_path, rows, OBSERVED, lambda f: stateful.emissions_stream(f, "10 minutes"), end, late=timedelta(minutes=10)).where("user_id < 9")
    kept = same(got, alerts.emissions(spark.createDataFrame(rows, OBSERVED), str(sec(at + 7200 - 600))))
    assert any("heartbeat" in r for r in kept)


def emitted(spark, rows, until):
    df = spark.createDataFrame([(1, k, sec(s), *rest) for k, (s, *rest) in enumerate(rows)], OBSERVED)
    out = alerts.emissions(df, str(sec(until))).withColumn("s", F.unix_seconds("ts") - int((T0 - datetime(1970, 1, 1)).total_seconds()))
    return sorted((r.s, r.capture_id, r.reason) for r in out.collect())


@pytest.mark.parametrize("rows, until, want", [
    # silence: a beat of 20 seconds is over at 21, 42, ... until 300 seconds after the last observation
    ([(0, "x", None, None)], 50, [(0, 0, "app"), (21, 0, "heartbeat"), (42, 0, "heartbeat")]),
    ([(0, "x", None, None)], 10_000, [(0, 0, "app")] + [(21 * k, 0, "heartbeat") for k in range(1, 15)]),
    # an observation at the beat is the beat; a gap longer than the beat is filled before the next observation
    ([(0, "x", None, None), (21, "x", None, None)], 30, [(0, 0, "app"), (21, 1, "heartbeat")]),
    ([(0, "x", None, None), (50, "y", None, None)], 60, [(0, 0, "app"), (21, 0, "heartbeat"), (42, 0, "heartbeat"), (50, 1, "app")]),
    # an unchanged frame emits nothing, and its attempt counts; one in twenty cells is a change
    ([(0, "x", None, [10] * 40), (5, "y", None, [10] * 39 + [90]), (9, "y", "u", [10] * 38 + [90] * 2)], 25, [(0, 0, "app"), (9, 2, "url")]),
    ([(0, "x", None, [10] * 40), (10, "x", None, [99] * 40)], 400, [(0, 0, "app"), (21, 1, "heartbeat")]),
])
def test_beats(spark, rows, until, want):
    assert emitted(spark, rows, until) == want
