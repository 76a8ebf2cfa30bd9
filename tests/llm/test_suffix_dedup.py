"""Suffix dedup against brute force: groups too large for one task, long texts, repeated rows, nulls, an empty table."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wakeline.llm import suffix_dedup

DOCS = "doc_id long, text string, node string, id string, spans int"


def brute_force(rows):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    out = []
    for r, b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0
        out.append((r[0], len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest(), len(kept) < len(b), kept.decode(errors="ignore")))
    return Counter(out)


def result(spark, rows):
    return Counter(tuple(r) for r in suffix_dedup.suffix_dedup(spark.createDataFrame([(*r, "x", "y", 0) for r in rows], DOCS)).collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    word = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage, other = word(130), word(90)
    rows = [(k, word(rng.randint(0, 60)) + passage + word(rng.randint(0, 60))) for k in range(14)]
    rows += [(20, passage), (21, passage + word(3)), (22, word(3) + passage), (23, passage[:420] + word(30)), (24, word(30) + passage[-430:])]
    rows += [(30, word(20) + other), (31, other + word(20)), (32, "a" * 900), (33, "a" * 401 + "b" + "a" * 399), (34, word(20) + passage + word(5) + passage)]
    rows += [(k, rows[3][1]) for k in (40, 41, 3, 3)] + [(None, rows[3][1]), (None, word(100)), (50, None), (51, ""), (52, "short"), (52, "short"), (53, word(200))]
    return rows


@pytest.mark.parametrize("most", [8192, 6, 2])
def test_groups_of_any_size(spark, texts, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", most)
    assert result(spark, texts) == brute_force(texts)


def test_text_longer_than_a_chunk():
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 100, size=9000, dtype=np.uint8)
    whole = suffix_dedup.anchors_of(buf, np.array([0, len(buf)]))
    saved, suffix_dedup.CHUNK = suffix_dedup.CHUNK, 1000
    try:
        parts = suffix_dedup.anchors_of(buf, np.array([0, len(buf)]))
    finally:
        suffix_dedup.CHUNK = saved
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_multikey_quicksort():
    rng = np.random.default_rng(4)
    group, chars = np.sort(rng.integers(0, 5, size=400)), rng.integers(0, 4, size=(400, 2)).astype(np.uint64)
    order, equal = suffix_dedup.multikey_quicksort(group, chars)
    key = [(g, *c) for g, c in zip(group.tolist(), chars.tolist(), strict=True)]
    assert [key[i] for i in order] == sorted(key)
    assert {tuple(sorted(order[i:j])) for i, j in equal} == {tuple(i for i in range(400) if key[i] == k) for k, n in Counter(key).items() if n > 1}


def test_empty_table(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], DOCS)).collect() == []
