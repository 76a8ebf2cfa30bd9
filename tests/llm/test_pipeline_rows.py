"""The stages language and benchmark against their rules, with null ids and with one id on two texts."""

import corpus_pipeline
from wakeline.llm import language_id

ITEM = "one two three four five six seven eight nine ten"


def test_rows_are_judged_by_id_and_text(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    bad_language, leak, clean = "12 34 !", f"here stands {ITEM} again", "nothing of that kind at all"
    rows = [(i, t, "en", "a", 0) for i in (None, 1, 2) for t in (clean, leak, bad_language, None)] + [(3, clean, "en", "a", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    kept = lambda df: sorted(map(tuple, df.collect()), key=key)
    assert kept(corpus_pipeline.benchmark(spark, docs, f"file://{tmp_path}")) == sorted((r for r in rows if r[1] != leak), key=key)
    monkeypatch.setattr(corpus_pipeline, "SCORE", 0.0)  # every text with a letter has a language
    model = language_id.train([b"nothing of that kind", b"rien de tout cela"], ["en", "fr"], steps=2)
    monkeypatch.setattr(language_id, "learn", lambda docs: model)
    assert kept(corpus_pipeline.language(spark, docs, "")) == sorted((r for r in rows if r[1] in (clean, leak)), key=key)
