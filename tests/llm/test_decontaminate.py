"""Decontamination against brute force: items of 2 to 400 words, repeated words, ties, repeated rows, several passes, odd columns."""

import random
from collections import Counter

import numpy as np
import pytest

from wakeline.llm import decontaminate

DOCS = "doc_id long, text string, item_id string, similarity int"
ITEMS = "item_id long, text string, doc_id string"


def shingles(w):
    return [tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute_force(docs, items):
    out = Counter()
    for doc_id, text in docs:
        w = (text or "").split()
        for item_id in {i for i, _ in items if i is not None}:
            best = None
            for own in (t.split() for i, t in items if i == item_id and t and t.split()):
                size, bag = min(len(own), len(w)), Counter(shingles(own))
                for s in range(len(w) - size + 1 if w else 0):
                    other = Counter(shingles(w[s : s + size]))
                    if not bag.keys() & other.keys():
                        continue
                    similarity = sum((bag & other).values()) / sum((bag | other).values())
                    if similarity >= 0.75 and (best is None or (similarity, -s) > best[:2]):
                        best = (similarity, -s, size)
            if best:
                out[(doc_id, item_id, round(best[0], 9), -best[1])] += 1
    return out


def found(spark, docs, items):
    rows = decontaminate.contaminated(spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS), spark.createDataFrame([(*i, "y") for i in items], ITEMS)).collect()
    return Counter((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in rows)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    some = lambda n, v=vocab: [rng.choice(v) for _ in range(n)]
    items = [(k, " ".join(some(rng.choice([2, 3, 4, 5, 6, 8, 12, 30, 60, 100])))) for k in range(150)]
    items += [(150, " ".join(some(400))), (151, " ".join(["a", "b"] * 20)), (152, "one two three four five six"), (152, "one two three four five six"), (153, "one two three four five six"), (None, "v1 v2 v3"), (154, None), (155, " ")]
    items += [(160 + k, items[5][1]) for k in range(3)]
    docs = []
    for k in range(30):
        w = some(rng.randint(0, 40))
        for i in rng.sample(range(151), 2):
            own = items[i][1].split()
            if len(own) > 25 and rng.random() < 0.7:
                own[rng.randrange(len(own))] = "edited"
            w += own + some(rng.randint(0, 20))
        docs.append((k, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "one two three four five six " * 3), (103, "a b " * 50), (104, items[150][1]), (104, items[150][1]), (None, items[150][1]), (105, "one two three"), (106, items[150][1][:-4])]
    return docs, items


def test_equals_brute_force(spark, tables, monkeypatch):
    want = brute_force(*tables)
    assert sum(want.values()) > 60
    assert found(spark, *tables) == want
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 70)
    monkeypatch.setattr(decontaminate, "WINDOWS_AT_ONCE", 7)
    assert found(spark, *tables) == want


def test_all_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 63, size=200, dtype=np.uint64)
    windows = items[rng.integers(0, 200, size=300)]
    for _ in range(20):
        windows ^= (rng.random(300) < 0.9).astype(np.uint64) << rng.integers(0, 64, size=300).astype(np.uint64)
    near = np.bitwise_count(windows[:, None] ^ items[None, :]) <= decontaminate.RADIUS
    assert set(zip(*(x.tolist() for x in decontaminate.within_radius(windows, items)), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_recall_of_the_radius():
    """Of bags at a similarity near 0.75, the SimHash radius of 23 bits keeps nearly all (11 bits are expected, with a deviation of 3)."""
    rng = np.random.default_rng(3)
    kept = 0
    for _ in range(500):
        a = rng.integers(0, 1 << 63, size=70, dtype=np.uint64)
        b = np.concatenate([a[:60], rng.integers(0, 1 << 63, size=10, dtype=np.uint64)])  # 60 of 80
        x, y = decontaminate.simhash([a, b])
        kept += int(np.bitwise_count(x ^ y)) <= decontaminate.RADIUS
    assert kept >= 498


def test_empty_documents(spark, tables):
    assert not found(spark, [], tables[1])
