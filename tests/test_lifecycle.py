"""Documents from files, deletions over a graph of tables, and proposals that say nothing new."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeline.operators import cascade as C
from wakeline.operators import proposals
from wakeline.sources import documents, versions


def put(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def test_reindex_over_folders(spark, tmp_path, monkeypatch):
    a, b, index = tmp_path / "a", tmp_path / "b", str(tmp_path / "index")
    put(a / "one.txt", "first", 1_700_000_000)
    put(a / "deep" / "two.md", "second", 1_700_000_000)
    put(b / "three.txt", "api_key=abc123", 1_700_000_000)
    put(b / "four.bin", "other kind", 1_700_000_000)
    run = lambda: {r.path.rpartition("/")[2]: (r.action, r.reason) for r in documents.reindex(spark, [str(a), str(b)], index).collect()}
    stored = lambda: {r.path.rpartition("/")[2]: r.text for r in versions.read(spark, index, "documents", documents.DOCUMENTS).collect()}
    assert run() == {"one.txt": ("indexed", None), "two.md": ("indexed", None), "three.txt": ("refused", "API key")}
    assert stored() == {"one.txt": "first", "two.md": "second"}
    assert run() == {"three.txt": ("refused", "API key")}  # the others are as they were
    put(a / "one.txt", "first again", 1_700_000_100)
    put(b / "three.txt", "no key now", 1_700_000_100)
    (a / "deep" / "two.md").unlink()
    put(b / "five.txt", "fifth", 1_600_000_000)
    # a run that fails before its end leaves the index as it was
    with monkeypatch.context() as m:
        m.setattr(versions, "point_to", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run()
    assert stored() == {"one.txt": "first", "two.md": "second"}
    assert run() == {"one.txt": ("indexed", None), "three.txt": ("indexed", None), "five.txt": ("indexed", None), "two.md": ("removed", None)}
    assert stored() == {"one.txt": "first again", "three.txt": "no key now", "five.txt": "fifth"}
    put(a / "one.txt", "password: hunter2", 1_700_000_200)
    assert run()["one.txt"][0] == "refused" and stored()["one.txt"] == "first again"


def test_cascade(spark, tmp_path):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "captures": C.Derived(make([(k,) for k in range(6)], "capture_id long"), "capture_id"),
        "commitments": C.Derived(make([(10, 0), (11, 1), (12, None)], "commitment_id long, capture_id long"), "commitment_id", [("capture_id", "captures")]),
        "reminders": C.Derived(make([(20, 10), (21, 11), (22, 12)], "reminder_id long, commitment_id long"), "reminder_id", [("commitment_id", "commitments")]),
        "episodes": C.Derived(make([(30, [0, 2]), (31, [2, 3]), (32, []), (33, None), (34, [3, 0, 0])], "episode_id long, ids array<long>"), "episode_id", [("ids", "captures")]),
        "notes": C.Derived(make([(40, 1, [31]), (41, 2, [30]), (42, 0, None)], "note_id long, c long, e array<long>"), "note_id", [("c", "captures"), ("e", "episodes")]),
        "free": C.Derived(make([(50,)], "free_id long"), "free_id"),
    }
    gone = make([(0,), (0,), (None,), (99,)], "id long")
    C.forget(spark, str(tmp_path), gone, tables)
    keys = {name: sorted(r[0] for r in spark.read.parquet(f"{versions.current(spark, str(tmp_path))}/{name}").select(t.key).collect()) for name, t in tables.items()}
    assert keys == {"captures": [1, 2, 3, 4, 5], "commitments": [11, 12], "reminders": [21, 22], "episodes": [31, 32, 33], "notes": [40], "free": [50]}
    nothing = C.cascade(make([], "id long"), tables)
    assert {n: df.count() for n, df in nothing.items()} == {n: t.rows.count() for n, t in tables.items()}
    with pytest.raises(ValueError):
        C.cascade(gone, {"reminders": tables["reminders"]})


def test_expired(spark):
    now = datetime(2024, 6, 1)
    rows = [(k, now - timedelta(days=d)) for k, d in enumerate([1, 183, 184, 184, 366, 367])]
    df, recalled = spark.createDataFrame(rows, "capture_id long, ts timestamp_ntz"), spark.createDataFrame([(3,), (3,), (4,), (5,)], "capture_id long")
    assert sorted(r[0] for r in C.expired(df, recalled, F.lit(now)).collect()) == [2, 5]


@pytest.mark.parametrize("known, offered, kept", [
    ([], ["Data Science student at UC San Diego", "DS student at UC San Diego in Data Science"], [0]),  # most words of the smaller one
    (["likes green tea"], ["likes green teas", "likes black coffee"], [1]),
    ([], ["lives in Berlin", "lives in Bern"], [0]),  # ratio
    ([], ["abcdefgh", "abcdefxy", "abcdwxyz"], [0, 2]),  # 0.75 goes, 0.5 stays
    ([], ["allergic to peanuts", "allergic to pollen and peanuts", "plays the old violin on Sundays"], [0, 2]),
    ([], ["one two three four", "one two nine five six seven", "two nine five six seven eight"], [0, 1]),  # an accepted one rejects a later one
    (["x"], [None, "  ", "y"], [2]), ([], ["same", "same"], [0]),
])
def test_new_proposals(spark, known, offered, kept):
    old = spark.createDataFrame([(1, t) for t in known] + [(2, t) for t in offered if t], "user_id long, text string")
    new = spark.createDataFrame([(1, k, t) for k, t in enumerate(offered)], "user_id long, proposal_id long, text string")
    assert sorted(r.proposal_id for r in proposals.new_proposals(new, old).collect()) == kept


def test_proposals_in_blocks(spark, monkeypatch):
    """Blocks, and the bounds before the exact comparison, leave the fold's result as it is; few pairs are compared letter by letter."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeinrst h") for _ in range(rng.randint(2, 9))) for _ in range(60)] + ["Ünïcödé", "漢字漢字", "x"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 12, 40])))
    lines = [line() for _ in range(150)]
    lines += [t[: rng.randint(1, len(t))] + rng.choice(["", "st", " xyz"]) for t in rng.sample(lines, 60)]
    known = [(u, t) for u, t in [(None, line()), *((k % 2, line()) for k in range(30))]]
    new = [(rng.choice([0, 1, None]), None if k % 50 == 7 else k, rng.choice([t, t, t.upper(), f" {t} "])) for k, t in enumerate(lines)]
    want, state = [], {}
    for u, t in known + [(u, t) for u, k, t in new if k is None]:
        state.setdefault(u, []).append(proposals.Fact(t.strip()))
    for u, k, t in new:
        if k is not None and t.strip():
            fact = proposals.Fact(t.strip())
            if not any(fact.like(x) for x in state.setdefault(u, [])):
                state[u].append(fact)
                want.append(k)
    monkeypatch.setattr(proposals, "TASKS", 2)
    monkeypatch.setattr(proposals, "AT_ONCE", 9)
    for size in (40, 4_096):
        monkeypatch.setattr(proposals, "BLOCK", size)
        got = proposals.new_proposals(spark.createDataFrame(new, "user_id long, proposal_id long, text string"), spark.createDataFrame(known, "user_id long, text string"))
        assert sorted(r.proposal_id for r in got.collect()) == want


def test_bounds_spare_comparisons(monkeypatch):
    rng, pairs = random.Random(1), []
    real = proposals.SequenceMatcher
    monkeypatch.setattr(proposals, "SequenceMatcher", lambda *a: pairs.append(a) or real(*a))
    held = proposals.Known()
    for _ in range(200):
        held.taken([proposals.Fact("".join(rng.choice("etaoinshrdlu ") for _ in range(rng.randint(50, 90))))])
    assert len(held.facts) > 190 and len(pairs) < 200
