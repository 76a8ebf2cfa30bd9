"""The manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root, and for each node (left, right) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            low = k // 16 * 16
            paths[i].append(("".join(nodes[low:k]), "".join(nodes[k + 1 : low + 16])))
        at = [k // 16 for k in at]
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    rows = [r[:5] for r in rows]
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, out = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        subs.append((own, *tree([leaf(*r) for r in own])))
    root, tops = tree([x[1] for x in subs]) if subs else (None, [])
    for (own, sub, paths), top in zip(subs, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            path = path + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None else None
            now = leaf(*r[:4], low) if hit else leaf(*r)
            for left, right in path:
                now = h(left, now, right)
            out.append((str(r[0]), leaf(*r), sub, root, h(*(x for p in path for x in p)), now, now == root))
    return sorted(out)


def found(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return sorted((str(r.doc_id), *r[1:]) for r in merkle.op11_merkle(spark, str(path)).collect())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i * 3, None if i % 50 == 7 else f"s{i % 40 if i % 3 else 0}", "en", i, f"Text {i} É" if i % 9 else None, "clash", i) for i in range(900)]
    rows += [(None, "s0", None, None, "", "", 1), (None, "s0", "de", 3, "Null id", "", 1), (-5, "s0", "de", 3, "Negative", "", 1), (1 << 62, "s0", "de", 3, "Far", "", 1), (-(1 << 63), "é", "de", 3, "A" * 70_000, "", 1), ((1 << 63) - 1, "é", "de", 3, "Z", "", 1)]
    rng.shuffle(rows)
    got = found(spark, rows, tmp_path)
    assert got == brute(rows)
    assert {x[-1] for x in got} == {True, False}


def test_repeated_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 7)
    same = (8, "s", "en", 1, "Same Row", "", 1)
    rows = [same] * 40 + [(8, "s", "en", 1, f"other {i}", "", 1) for i in range(30)] + [(i, "s", "en", 1, "one", "", 1) for i in range(20) if i != 8]
    rows += [(None, None, None, None, None, "", 1)] * 19 + [(70_000, "s", "en", 1, "far", "", 1)] * 2
    assert found(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("sizes", [[], [1], [17], [1, 16, 17, 256, 257], [1] * 300])
def test_trees_of_sizes(spark, tmp_path, sizes):
    rows = [(1000 * k + i, f"s{k:03}", "en", 1, f"t{i}", "", 1) for k, n in enumerate(sizes) for i in range(n)]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_ranks_of_ids_far_apart(spark):
    rng = np.random.default_rng(1)
    ids = np.unique(np.concatenate([rng.integers(-(1 << 63), (1 << 63) - 1, 3000), np.arange(100_000, 140_000)]))
    df = spark.createDataFrame([(f"g{i % 2}", int(x)) for i, x in enumerate(ids)], "g string, doc_id long").repartition(4)
    got = merkle.ranked(df, "doc_id").groupBy("g").agg(F.collect_list(F.struct("doc_id", "rank", "total", "copies")).alias("x")).collect()
    for r in got:
        want = ids[int(r.g[1]) :: 2]
        assert sorted((x.doc_id, x.rank) for x in r.x) == [(int(v), i) for i, v in enumerate(want)]
        assert {(x.total, x.copies) for x in r.x} == {(len(want), 1)}


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 40_000, 65_536])
def test_bitmaps_round_trip(n):
    lows = np.sort(np.random.default_rng(2).permutation(65_536)[:n])
    packed = merkle.pack(lows)
    assert len(packed) <= 8192 and (merkle.unpack(packed) == lows).all()
