"""Streams against their batch twins, and round trips of the sinks."""

from collections import Counter

from pyspark.sql import functions as F

from wakeline.sources import sinks
from wakeline.sources.captures import captures
from wakeline.streaming import feeds

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(str, df.collect()))


def test_stream_agrees(spark, tmp_path):
    df = captures(spark, SF, text=True).withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        df.where(F.col("ts").between(f"2024-01-{1 + 10 * i:02}", f"2024-01-{11 + 10 * i:02}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    feed = lambda: feeds.read_feed(spark, str(tmp_path / "in"), df.schema, files=1)
    for call in (1, 2):
        feeds.sweep(feeds.once(feed(), "60 days"), str(tmp_path / "out"), str(tmp_path / "mark"))
        assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(feeds.once(df)), call
    feeds.sweep(feeds.enriched(feed()), str(tmp_path / "rich"), str(tmp_path / "mark2"))
    assert rows(spark.read.parquet(str(tmp_path / "rich"))) == rows(feeds.enriched(df))
    feeds.sweep(feeds.counts_by_hour(feed(), "60 days"), str(tmp_path / "hours"), str(tmp_path / "mark3"))
    got, want = rows(spark.read.parquet(str(tmp_path / "hours"))), rows(feeds.counts_by_hour(df))
    assert not got - want  # hours that the watermark has not passed are still open


def test_sinks(spark, tmp_path):
    df = captures(spark, SF).withColumn("day", F.to_date("ts"))
    sinks.rebuild_days(df, str(tmp_path / "days"))
    before = rows(spark.read.parquet(str(tmp_path / "days")))
    sinks.rebuild_days(df.where("day = '2024-01-05'"), str(tmp_path / "days"))
    assert rows(spark.read.parquet(str(tmp_path / "days"))) == before
    sinks.export_csv(df.select("capture_id", "window_title"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == df.count()
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 0, None)], "k int, at int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], "at").collect()), key=str) == [(1, 1, "c"), (2, 5, "b"), (3, 0, None)]
    (tmp_path / "log").write_text('{"app": "x", "ms": 3}\nnot json\n{"app": "y", "ms": 4}\n')
    assert sorted(r.ms for r in sinks.read_log(spark, str(tmp_path / "log"), "app string, ms long").collect()) == [3, 4]
