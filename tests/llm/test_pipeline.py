"""Each stage of the pipeline against brute force, and all of them on small tables with nulls, repeats and other columns."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from wakeline.llm import language_id, mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
VOCAB = {"en": "the of and to in is that was for on with as it be at by this had not are but from".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        out.append((i, " ".join(rng.choice(VOCAB[lang]) + str(rng.randint(0, 9)) * (rng.random() < 0.3) for _ in range(rng.randint(30, 120))), lang, rng.choice(["a", "b", "c", None]), 0, "x"))
    text = out[5][1].split()
    out += [(70, out[5][1], "en", "a", 0, "x"), (71, " ".join(text[:-1] + ["other"]), "en", "b", 0, "x"), (72, " ".join(text + ["more", "words"]), "en", "a", 0, "x")]
    out += [(80, None, None, "a", 0, "x"), (81, "", "en", None, 0, "x"), (82, "12 34 !", "en", "b", 0, "x"), (None, out[9][1], "de", "a", 0, "x"), (None, out[5][1], "de", "a", 0, "y"), (83, out[7][1], "en", "a", 0, "x"), (83, out[7][1], "en", "a", 0, "x")]
    out.append((90, " ".join(out[11][1].split() + [f"{k} letters" for k in range(3000)]), "en", "c", 0, "x"))
    return out


def plain(df):
    return Counter(map(tuple, df.collect()))


def test_near_copies_keeps_one_of_each_group(spark, rows):
    kept = plain(corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, COLUMNS), ""))
    distinct = list(dict.fromkeys((r[0], r[1]) for r in rows))
    sets = [shingles(t) for _, t in distinct]
    comp = list(range(len(distinct)))
    for _ in distinct:
        for a in range(len(distinct)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    best = {}
    for k, (i, _) in enumerate(distinct):
        at = (i is None, i if i is not None else 0)
        if comp[k] not in best or at < best[comp[k]][0]:
            best[comp[k]] = (at, distinct[k])
    assert Counter((r[0], r[1]) for r in kept.elements()) == Counter(v for _, v in best.values())
    assert len(kept) < len(set(rows)) and all(r in set(rows) for r in kept)


def test_benchmark_goes_and_clean_rows_stay(spark, rows, tmp_path):
    item = " ".join(rows[20][1].split()[3:25])
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    kept = plain(corpus_pipeline.benchmark(spark, spark.createDataFrame(rows, COLUMNS), f"file://{tmp_path}"))
    gone = Counter(rows) - kept
    assert set(r[0] for r in gone) == {20} and not kept - Counter(rows)


def test_language_keeps_what_has_a_language(spark, rows, monkeypatch):
    model = language_id.train([r[1][:64].encode() for r in rows[:60]], [r[2] for r in rows[:60]], steps=30)
    monkeypatch.setattr(language_id, "learn", lambda docs: model)
    kept = plain(corpus_pipeline.language(spark, spark.createDataFrame(rows, COLUMNS), ""))
    lettered = [r for r in rows if r[1] and re.search("[a-zäöü]", r[1])]
    offsets = np.concatenate([[0], np.cumsum([len(r[1].encode()) for r in lettered])])
    score = language_id.document_probabilities(np.frombuffer("".join(r[1] for r in lettered).encode(), dtype=np.uint8), offsets, model).max(axis=1)
    want = Counter(r for r, s in zip(lettered, score, strict=True) if round(s, 6) >= 0.5 + 0.5 * corpus_pipeline.SCORE)
    assert kept == want and sum(want.values()) > 50


def test_without_labels_only_texts_without_a_letter_go(spark, rows):
    some = [(*r[:2], None, *r[3:]) for r in rows]
    kept = plain(corpus_pipeline.language(spark, spark.createDataFrame(some, COLUMNS), ""))
    assert kept == Counter(r for r in some if r[1] and re.search("[a-zäöü]", r[1]))


def test_mix_repeats_rows(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    mixed, again = plain(corpus_pipeline.mix(spark, df, "")), plain(corpus_pipeline.mix(spark, df, ""))
    rate = {r.source: r.target / r.source_size if r.source_size else 0 for r in mixing.source_targets(df.select("source", mixing.word_count().alias("size"))).collect()}
    times = Counter(rows)
    assert mixed == again and set(mixed) <= set(times)
    for row, n in times.items():
        assert mixed[row] / n in (int(rate[row[3]]), int(rate[row[3]]) + 1)


def test_all_stages(spark, rows, tmp_path):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[20][1].split()[3:25]))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    ids = {r.doc_id for r in got}
    assert not ids & {20, 70, 71, 80, 81, 82} and len(ids) > 10
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"file://{tmp_path}").columns == docs.columns
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
