"""The Jaccard join under small bounds: heavy shingles, long postings, blocks; repeated and null ids; an empty table."""

import random
import re

import pytest

from wakeline.llm import jaccard_join as J

DOCS = "doc_id long, text string, node string, t int"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if comp[a] != comp[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted((str(i), len(s), least.get(c) if s else i) for (i, _), s, c in zip(rows, sets, comp, strict=True))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    base = [rng.choice(vocab) for _ in range(50)]
    out = []
    for k in range(45):  # one large group, of which not all link with each other
        own = list(base)
        for at in rng.sample(range(50), rng.randint(0, 4)):
            own[at] = f"x{k}"
        out.append((k, " ".join(own)))
    out += [(100 + k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30)))) for k in range(25)]
    out += [(200, " ".join(base)), (200, " ".join(base)), (None, " ".join(base)), (None, None), (201, None), (201, ""), (202, "Two words"), (203, "two  WORDS"), (204, " ".join(base) * 40)]
    return out


@pytest.mark.parametrize("heavy, short, block", [(50_000, 16, 4096), (5, 3, 4), (1, 1, 2)])
def test_equals_brute_force(spark, rows, monkeypatch, heavy, short, block):
    for name, value in (("HEAVY_ROWS", heavy), ("SHORT_POSTING", short), ("BLOCK_ROWS", block), ("SALTS", 3)):
        monkeypatch.setattr(J, name, value)
    df = J.jaccard_components(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS))
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in df.collect()) == brute_force(rows)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []
