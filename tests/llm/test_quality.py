"""Base counts and the Kneser-Ney model against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wakeline.llm import kernels, quality

SCHEMA = "doc_id long, lang string, text string, n_words string, kept int"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def texts():
    rng = random.Random(4)
    vocab = ["the", "a", "Of", "café", "naïve", "日本", "x#y", "<b>", "😀", "ıİ"]
    out = [None, "", " \n\t", "one", "a b", "a\na\n\na\nb", "same line\nsame line\n same line\r\n\n", "x y z x y z", "x y z\nx y z", "a a a a", "a a a", "\n", "b\x0bb\x0cb"]
    for _ in range(80):
        out.append("".join(rng.choice(vocab) + rng.choice([" ", "  ", "\n", "\n", "\t"]) for _ in range(rng.randint(1, 120))))
    out.append("long word salad " * 40_000)
    return out


def test_base_counts(spark):
    rows = [(i, "en", t, "clash", 1) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i, _, t, *_ in rows:
        r, want = got[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:80] if t else t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def plain_symbols(text):
    out = []
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        c = "0" if c in "0123456789" else " " if c in " \t\n\x0b\x0c\r" else "￿" if ord(c) > 0xFFFF else low
        if c != " " or out[-1:] != [" "]:
            out.append(c)
    return out


def plain_model(sequences):
    """Interpolated modified Kneser-Ney over tuples; BEFORE pads, as in the module."""
    n_max, counts = quality.ORDER, {}
    counts[n_max] = Counter(tuple(s[i - n_max + 1 : i + 1]) for s in sequences for i in range(n_max - 1, len(s)))
    for n in range(n_max - 1, 0, -1):
        c = Counter()
        for gram, k in counts[n + 1].items():
            c[gram[1:]] += k if gram[1] == quality.BEFORE else 1
        counts[n] = c
    d, by_context = {}, {}
    for n in counts:
        of = Counter(counts[n].values())
        d[n] = [0, 0.5, 1, 1.5]
        if all(of[k] for k in (1, 2, 3, 4)):
            y = of[1] / (of[1] + 2 * of[2])
            own = [0] + [k - (k + 1) * y * of[k + 1] / of[k] for k in (1, 2, 3)]
            if all(0 < own[k] < k for k in (1, 2, 3)):
                d[n] = own
        by_context[n] = defaultdict(list)
        for gram, k in counts[n].items():
            by_context[n][gram[:-1]].append(k)

    def p(gram):
        if not gram:
            return 1 / (quality.CLASSES - 1)
        n = len(gram)
        there = by_context[n].get(gram[:-1])
        if not there:
            return p(gram[1:])
        gamma = sum(d[n][min(k, 3)] for k in there) / sum(there)
        k = counts[n].get(gram, 0)
        return (k - d[n][min(k, 3)] if k else 0) / sum(there) + gamma * p(gram[1:])

    return p


def test_model_equals_plain_kneser_ney(spark):
    rows = [(i, "xx" if i % 3 else None, t, "clash", 1) for i, t in enumerate(texts()[:-1])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    scored, languages = quality.score(df)
    got = {r.doc_id: r for r in scored.collect()}
    for lang in ("xx", None):
        own = [(i, plain_symbols(t or "")) for i, x, t, *_ in rows if x == lang]
        common = Counter(c for _, s in own for c in s)
        classes = {c: quality.FIRST + k for k, c in enumerate(sorted(common, key=lambda c: (-common[c], ord(c)))[: quality.ALPHABET])}
        sequences = {i: [quality.BEFORE] * (quality.ORDER - 1) + [classes.get(c, quality.OTHER) for c in s] for i, s in own}
        p = plain_model(list(sequences.values()))
        for i, s in sequences.items():
            logs = [math.log(p(tuple(s[k - quality.ORDER + 1 : k + 1]))) for k in range(quality.ORDER - 1, len(s))]
            assert got[i].log_perplexity == pytest.approx(-sum(logs) / max(1, got[i].n_words), rel=1e-5, abs=1e-6)
            assert got[i].lang == (languages.index(lang) + 1 if lang else 0)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    classes = rng.integers(1, 9, size=400).astype(np.uint8)
    keys, counts = np.unique(quality.ngrams(classes, np.repeat([0, 1], 200)), return_counts=True)
    model = quality.estimate(keys, counts)
    for context in (keys[0] >> 8, keys[-1] >> 8, 0, 0x3F3F3F, 0x013F02):
        every = np.array([(context << 8 | c) for c in range(1, quality.CLASSES)], dtype=np.int64)
        assert np.exp(quality.log_probabilities(every, model)).sum() == pytest.approx(1, rel=1e-5)


def prose(rng, n, letters="abcdefghij"):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    return " ".join(rng.choice(words) for _ in range(n))


def test_bands_reject_both_sides(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    rows = [(i, "aa", " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=120)), "", 1) for i in range(200)]
    rows += [(1000 + i, "aa", " ".join("".join(rng.choice("qxzkvwyu#%") for _ in range(5)) for _ in range(80)), "", 1) for i in range(3)]
    # the six commonest words, every three of them in turn once
    line, seen = [0, 0, 0], {(0, 0, 0)}
    while step := [k for k in (5, 4, 3, 2, 1, 0) if (*line[-2:], k) not in seen]:
        seen.add((*line[-2:], step[0]))
        line.append(step[0])
    rows += [(2000, "aa", " ".join(words[k] for k in line), "", 1)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(200))
    assert not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(3)) and got[1000].log_perplexity > got[1000].upper
    assert not got[2000].base_failed and got[2000].log_perplexity < got[2000].lower and not got[2000].kept
    monkeypatch.setattr(quality, "MODEL_BYTES", 1)  # a pass for each language
    monkeypatch.setattr(quality, "HELD", 10)
    more = rows + [(3000 + i, [None, "bb", "cc"][i % 3], prose(rng, 60), "", 1) for i in range(30)] + [(None, None, None, "", 1)]
    again = {r.doc_id: r for r in quality.quality(spark.createDataFrame(more, SCHEMA)).collect()}
    assert {i: again[i] for i in got} == got and len(again) == len(more)


def test_many_languages_share_a_model(spark, monkeypatch):
    monkeypatch.setattr(quality, "LANGUAGES", 1)
    rng = random.Random(2)
    rows = [(i, ["aa", "aa", "bb", None][i % 4], prose(rng, 60), "", 1) for i in range(40)]
    scored, languages = quality.score(spark.createDataFrame(rows, SCHEMA))
    assert languages == ["aa"] and {r.doc_id % 4: r.lang for r in scored.collect()} == {0: 1, 1: 1, 2: 0, 3: 0}


def test_empty(spark, tmp_path):
    assert quality.quality(spark.createDataFrame([], SCHEMA)).collect() == []
    spark.createDataFrame([(1, None, None, "", 1)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = quality.op13_quality(spark, str(tmp_path)).collect()
    assert (row.doc_id, row.n_words, row.base_failed, row.kept) == (1, 0, True, False)


def test_symbols_fold():
    buf, offsets = kernels.utf8(__import__("pyarrow").array(["Ab  9\n é日😀", None, "  x"]))
    found, text = quality.symbols(buf, offsets)
    assert [chr(c) for c in found] == ["a", "b", " ", "0", " ", "é", "日", "￿", " ", "x"] and text.tolist() == [0] * 8 + [2] * 2
