"""Merges that are killed between their write and their mark, and started again."""

from datetime import datetime, timedelta

import pytest

from wakeline.operators import episodes
from wakeline.sources import versions
from wakeline.streaming import feeds

SCHEMA = "k long, v string, at long"


def rows(spark, root):
    return sorted(map(tuple, versions.merged(spark, root, SCHEMA).collect()))


def test_merge(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    merge = lambda changes, batch: versions.merge(spark, root, changes, batch, SCHEMA, ["k"], "at", buckets=4)
    assert rows(spark, root) == [] and versions.last_batch(spark, root) == -1
    assert merge(df((1, "a", 1), (2, "b", 1), (1, "c", 0), (None, "n", 1)), 0)
    first = {r[0]: r[1] for r in versions.merged(spark, root, SCHEMA).collect()}
    assert first == {1: "a", 2: "b", None: "n"}
    with monkeypatch.context() as m:
        m.setattr(versions, "point_to", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            merge(df((1, "late", 0), (2, "new", 1), (3, "d", 1)), 1)
    assert {r[0]: r[1] for r in versions.merged(spark, root, SCHEMA).collect()} == first and versions.last_batch(spark, root) == 0
    for again in (True, False):  # the batch comes once more, and once too often
        assert merge(df((1, "late", 0), (2, "new", 1), (3, "d", 1)), 1) is again
    assert {r[0]: r[1] for r in versions.merged(spark, root, SCHEMA).collect()} == {1: "a", 2: "new", 3: "d", None: "n"}
    assert merge(df(), 2) and versions.last_batch(spark, root) == 2


def test_merge_stream(spark, tmp_path, monkeypatch):
    schema = "k long, v string, at long, ts timestamp"
    seen, root, mark = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "mark")
    put = lambda *r: spark.createDataFrame([(*x, datetime(2024, 1, 1) + timedelta(hours=x[2])) for x in r], schema).coalesce(1).write.mode("append").parquet(seen)
    run = lambda: versions.merge_stream(feeds.read_feed(spark, seen, spark.createDataFrame([], schema).schema, files=1), root, mark, SCHEMA, ["k"], "at")
    put((1, "a", 1), (2, "b", 1))
    run()
    put((1, "c", 2), (3, "d", 1))
    real = versions.point_to
    with monkeypatch.context() as m:  # killed after the merge is done, before the stream notes the batch
        m.setattr(versions, "point_to", lambda *a: _then_die(real, *a))
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    assert rows(spark, root) == [(1, "c", 2), (2, "b", 1), (3, "d", 1)]


def _then_die(real, *a):
    real(*a)
    raise OSError("killed")


def test_backfill_goes_on(spark, tmp_path):
    root = str(tmp_path / "v")
    docs = spark.createDataFrame([(k, None if k == 3 else "" if k == 4 else f"word {k}") for k in range(12)], "doc_id long, text string")
    assert episodes.backfill_job(docs, root, batch=5, most=1) == 1
    assert sorted(r.doc_id for r in versions.merged(spark, root, episodes.VECTORS).collect()) == [7, 8, 9, 10, 11]  # newest first
    assert episodes.backfill_job(docs, root, batch=5) == 2 and episodes.backfill_job(docs, root, batch=5) == 0
    got = {r.doc_id: r.vector for r in versions.merged(spark, root, episodes.VECTORS).collect()}
    assert sorted(got) == [0, 1, 2, *range(4, 12)] and got[4] == [] and len(got[5]) == episodes.HASH_BITS
