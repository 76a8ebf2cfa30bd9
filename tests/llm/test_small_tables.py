"""Mixing, token shards and URL rules on odd tables: reruns, capped sources, the salted path, special tokens, several shards, clashing columns, none at all."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wakeline.llm import mixing, token_output, url_filter


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(6)
    sizes = {"a": 400, "b": 30, "c": 300, "d": 5, None: 200, "": 1}  # b and d are capped
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), s, "x", 1.0))
            i += 1
    return rows + [(None, "one two", "a", "x", 1.0), (0, None, "a", "x", 1.0)]


COLUMNS = "doc_id long, text string, source string, copies string, target double"


@pytest.mark.parametrize("most", [10_000, 2])
def test_mix_is_near_its_targets(spark, sources, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)  # 2: the salted path
    df = spark.createDataFrame(sources, COLUMNS)
    sized = df.select("doc_id", "source", mixing.word_count().alias("size"))
    targets = {r.source: (r.source_size, r.target) for r in mixing.source_targets(sized).collect()}
    rows = mixing.with_copies(sized, mixing.source_targets(sized)).select("doc_id", "source", "size", "copies").collect()
    assert len(rows) == len(sources) and all(0 <= r.copies <= 3 for r in rows)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.with_copies(sized, mixing.source_targets(sized)).select("doc_id", "source", "size", "copies").collect()))
    taken, spread = defaultdict(int), defaultdict(float)
    for r in rows:
        size, target = targets[r.source]
        f = (target / size) % 1 if size else 0
        taken[r.source] += r.size * r.copies
        spread[r.source] += r.size**2 * f * (1 - f)
    assert targets["d"][1] == 3 * targets["d"][0]
    assert all(abs(taken[s] - target) <= 3 * spread[s] ** 0.5 + 1e-6 for s, (_, target) in targets.items())


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(spark.createDataFrame([], COLUMNS)).collect() == []


def test_token_shards_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_IDS", 300)
    monkeypatch.setattr(token_output, "FRAME_IDS", 64)
    monkeypatch.setattr(token_output, "SLICE_CHARS", 50)
    texts = ["a<|endoftext|>b", " lead\tand\r\n\n tail  ", "It's we'll DON'T 'd x", "漢字 ½ ² — “q” 😀é", "", None, "w " * 400, "x" * 700, "same", "same", " ", " a　b \x1c c"]
    rows = [(k * 7 % 11, t, "clash") for k, t in enumerate(texts)] + [(None, "null id", "clash"), (3, "repeated id", "clash")]
    got = token_output.token_output(spark.createDataFrame(rows, "doc_id long, text string, start string"), f"file://{tmp_path}/t").orderBy("start").collect()
    tok, at, seen = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, Counter()
    for r in got:
        assert r.start == at
        at += r.n_tokens
        seen[(r.doc_id, r.n_tokens, r.ids_crc32)] += 1
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")) for i, t, _ in rows]
    assert seen == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)


def test_shards_whose_uuid_looks_like_a_number(spark, tmp_path):
    ids = {0: [*range(5, 35), 2], 1: [7, 2], 2: [9, 9, 9, 2], 3: [2]}
    for uuid in ("c1234567-89ab-4cde-8f01-23456789abcd", "0a234567-c2ab-4cde-8f01-23456789abcd", "0a234567-89ab-4cde-8f01-c3456789abcd"):
        (folder := tmp_path / uuid).mkdir()
        for k, doc in ids.items():
            shard = token_output._shard([(k, np.array(doc, dtype="<u4").tobytes())])
            (folder / f"part-{k // 3:05}-{uuid}-c{k % 3:03}.txt").write_bytes(shard + token_output.LINE_END.encode())
        got = token_output.read_token_shards(spark, f"file://{folder}").orderBy("doc_id").collect()
        assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(0, 0, 31), (1, 31, 2), (2, 33, 4), (3, 37, 1)]


def test_no_token_shards(spark, tmp_path):
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "false")
    assert token_output.token_output(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none").collect() == []


def test_urls_of_odd_rows(spark):
    rows = [(1, "http://a.com/", "h", "kept"), (1, "http://a.com/", "h", "kept"), (2, None, "h", "kept"), (3, "", "h", "kept"), (4, "http://x.org/" + "casino" + "a" * 100_000, "h", "kept"), (5, "http://x.org/" + "a/" * 50_000 + "casino", "h", "kept")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, extra string")).collect()
    assert {(r.page_id, r.host, r.verdict, r.extra) for r in got} == {(1, "a.com", "allow", "kept"), (2, "", "allow", "kept"), (3, "", "allow", "kept"), (4, "x.org", "allow", "kept"), (5, "x.org", "block", "kept")} and len(got) == 6
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
