"""Operators of the training-data subpackage against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wakeline.llm import ann, decontaminate, jaccard_join, language_id, license_scan, mixing, suffix_dedup, token_output, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(160)]
    texts = [None, "", " \n", "one", "Two words", " ".join(base), " ".join(base), "é" * 300 + "x"]
    for _ in range(25):
        own = list(base)
        for k in rng.sample(range(160), rng.randint(1, 6)):
            own[k] = rng.choice(vocab) + "x"
        texts.append(" ".join(own))
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 300))) for _ in range(20)]
    texts.append(" ".join(rng.choice(vocab) for _ in range(9000)))
    return [(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], 0, "clash") for i, t in enumerate(texts)]


def test_jaccard_components(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    sets = {r[0]: shingles(r[1]) for r in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    assert got == {i: (len(s), comp[i]) for i, s in sets.items()}


def test_suffix_dedup(spark, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    seen = Counter(b[k : k + 400] for b in raw.values() for k in range(len(b) - 399))
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0
        assert got[i] == (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())


def test_blind_trie_orders():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    order = suffix_dedup.BlindTrie(strings).ordered()
    assert [strings[i] for i in order] == sorted(strings)


def test_decontaminate(spark, rows):
    items = [(1, " ".join((rows[5][1] or "").split()[20:50])), (2, "nothing of this kind stands anywhere at all"), (3, None), (4, "")]
    found = decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    w = words(items[0][1])
    bag = lambda x: Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
    want = set()
    for i, t, *_ in rows:
        own = words(t)
        for s in range(max(0, len(own) - len(w) + 1)):
            a, b = bag(own[s : s + len(w)]), bag(w)
            if sum((a & b).values()) >= 0.75 * sum((a | b).values()):
                want.add((i, 1))
    assert {(r.doc_id, r.item_id) for r in found} == want and want


def test_token_round_trip(spark, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = token_output.token_output(spark.createDataFrame(rows, DOCS), f"file://{tmp_path}/tokens").orderBy("doc_id").collect()
    tok, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r, g in zip(rows, got, strict=True):
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert tuple(g) == (r[0], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_damaged_shard_is_refused():
    shard = bytearray(token_output._shard([(1, b"\1\0\0\0\2\0\0\0")]))
    assert [(d, x.tolist()) for d, x in token_output.read_documents(bytes(shard))] == [(1, [1, 2])]
    shard[-20] ^= 1
    with pytest.raises(ValueError):
        list(token_output.read_documents(bytes(shard)))


def test_mixing(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix_sources(df)
    assert mixed.columns == df.columns
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    targets = mixing.source_targets(df.select("source", mixing.word_count().alias("size"))).collect()
    total = sum(r.source_size for r in targets)
    assert abs(sum(r.target for r in targets) - total) < 1e-6 * max(total, 1)
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in targets)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_nearest_recall(spark):
    x = np.random.default_rng(2).normal(size=(600, 64))
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(600, None), (601, [0.0] * 64), (602, [float("nan")] * 64)]
    got = ann.nearest_neighbours(spark.createDataFrame(data, "vec_id long, embedding array<float>"), lambda v: v % 50 == 0).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 60 and hits >= 0.9 * 60


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.predict(df, language_id.learn(df)).join(df.select("doc_id", "lang", language_id.is_held_out().alias("h")), "doc_id").where("h").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95
    odd = spark.createDataFrame([(1, None, None), (2, "", None), (3, "12 34!", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.predict(odd, language_id.learn(df)).collect()] == [("und", 0.0)] * 3


def test_licences_urls_warc(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Some words.\nReleased under the MIT License.\nMore."), (2, None), (3, "This work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string")
    assert [(r.licence, r.verdict) for r in license_scan.scan_licences(docs).orderBy("doc_id").collect()] == [("MIT", "allow"), (None, "none"), ("GPL-3.0", "deny")]
    urls = ["http://Example.com/en/1", "http://www.example.com/en/1", "https://a.net/fr/x?y", "http://free-bets.org/", "http://freebets.org/", None, "casino"]
    pages = spark.createDataFrame([(i, u, "<p>Hi &amp; bye</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert [got[i][2] for i in range(7)] == ["block", "allow", "block", "block", "allow", "allow", "block"]
    assert got[0][:2] == ("example.com", "example.com/en/") and got[5][0] == ""
    folder = f"file://{tmp_path}/warc"
    warc.write_warc(warc.derivatives(warc.responses(pages)), folder)
    texts = warc.read_warc(spark, folder).where("record_type = 'conversion'").collect()
    assert {bytes(r.block) for r in texts} == {b"Hi & bye"} and len(texts) == 7
