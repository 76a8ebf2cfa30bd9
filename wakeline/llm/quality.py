"""Operator 13, quality rules: counts of a text's own words and lines, then bands of N-gram perplexity for each language.

Texts are read as symbols (code points, lower-cased; digits are 0, runs of white space one space).  For each language:

1. Spark counts the symbols of all texts; the ALPHABET most frequent ones are classes of their own and all others share one.
2. Spark counts the ORDER-grams of classes of all texts; tasks add up their own first.
3. A task for each language turns the counts into an interpolated modified Kneser-Ney model: a sorted array of the 64-bit hashes of all n-grams up to
   ORDER (a bijection of the n-gram, so none collide) with log-probability and back-off beside it.
4. Every whole text is scored by binary search for its distinct n-grams: its log-perplexity is nats per word.  A language's band lies around the median of
   the texts that pass the base rules.  The mean over n words deviates by about scale / sqrt(n); the scale is taken from the quartiles of all deviations
   times sqrt(n), and the band reaches FENCE of that, LEAST_REACH at least.  Medians and quartiles are exact to STEP.

Below its band a text's words say less than the language's (tables, menus, lists of fragments); above it they aren't the language's.  Both are rejected.

With 64 classes and ORDER 4 a model has at most 64**4 n-grams a language by proof (some hundred thousand in practice).  Models are broadcast in groups
of MODEL_BYTES; with more languages there are more passes, each over the texts of its own languages.

The LANGUAGES most frequent languages have models of their own; all others, and null, share one.  A null text has no words; a text of fewer than
LEAST_WORDS words fails the base rules, whatever its perplexity.  Repeated rows are judged alike.  A language whose texts all fail has no band
and keeps none.  An empty table gives an empty result.  Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import mix64, powers, prefix_hash, slices, utf8, word_spans
from .shared import read_table, stored

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
ORDER = 4
ALPHABET = 60
#: Classes: before a text, any symbol beyond the alphabet, then the alphabet.
BEFORE, OTHER, FIRST = 0, 1, 2
CLASSES = FIRST + ALPHABET
LANGUAGES = 256
FENCE = 5.0
LEAST_REACH = 0.25  # nats a word
STEP = 0.001
#: The distance of the quartiles of a normal distribution, in standard deviations.
_QUARTILES = 1.349
MODEL_BYTES = 128 << 20
#: N-grams that a task adds up before it sends them on.
HELD = 1 << 22

_U = np.uint64
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A code point's symbol; those beyond the first plane are one.
_BEYOND = 0xFFFF
_FOLD = np.array([ord(c) if len(c := chr(i).lower()) == 1 and ord(c) < _BEYOND else i for i in range(1 << 16)], dtype=np.uint16)
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[ord("0") : ord("9") + 1] = ord("0")


# base rules --------------------------------------------------------------------------------------------------------------------------------


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text of a slice."""
    begin, end, first = word_spans(buf, offsets)
    n_texts, n_words = len(offsets) - 1, np.diff(first)
    blank = _BLANK[buf]
    out = {"n_words": n_words, "word_chars": _per_text(~blank & ((buf & 0xC0) != 0x80), offsets), "n_symbols": _per_text(_SYMBOLS[buf], offsets)}
    hashes = prefix_hash(buf)
    _, inverse = powers(len(buf))
    of_text = mix64(np.arange(1, n_texts + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))

    def spans(b: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix64((hashes[e] - hashes[b]) * inverse[b] + (e - b).astype(_U))

    # lines: a break ends one, a text's end the last
    breaks = np.flatnonzero(buf == 10)
    text = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    of = np.concatenate([np.arange(n_texts), text])
    order = np.lexsort((starts, of))
    starts, of = starts[order], of[order]
    last = np.ones(len(of), dtype=bool)
    last[:-1] = of[1:] != of[:-1]
    ends = np.where(last, offsets[of + 1], np.concatenate([starts[1:] - 1, [0]]))
    worded = np.searchsorted(begin, ends) > np.searchsorted(begin, starts)
    starts, ends, of = starts[worded], ends[worded], of[worded]
    again = pd.Series(mix64(spans(starts, ends) ^ of_text[of])).duplicated().to_numpy()
    out["n_dup_lines"] = np.bincount(of[again], minlength=n_texts)

    words = spans(begin, end)
    of_word = np.repeat(np.arange(n_texts), n_words)
    covered = np.zeros(len(words), dtype=bool)
    if len(words) > 2:
        whole = np.flatnonzero(of_word[2:] == of_word[:-2])
        key = mix64(words[whole] * _U(0xD1342543DE82EF95) + mix64(words[whole + 1] * _U(0xAF251AF3B0F025B5) + mix64(words[whole + 2])) + of_text[of_word[whole]])
        twice = whole[pd.Series(key).duplicated(keep=False).to_numpy()]
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = _per_text(covered, first)
    return out


# symbols and n-grams -----------------------------------------------------------------------------------------------------------------------


def symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts of a slice, and the text of each."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    wide = np.concatenate([buf, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
    a, b, c = (wide[lead + k] for k in range(3))
    point = np.where(a < 0xC0, a, np.where(a < 0xE0, (a & 0x1F) << 6 | b & 0x3F, np.where(a < 0xF0, (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F, _BEYOND)))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(lead, offsets)))
    out = _FOLD[point]
    again = np.zeros(len(out), dtype=bool)
    again[1:] = (out[1:] == 32) & (out[:-1] == 32) & (text[1:] == text[:-1])
    return out[~again], text[~again]


def ngrams(classes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The ORDER-gram that ends at each symbol, a byte a class, the last class lowest."""
    key = classes.astype(np.int64)
    for j in range(1, ORDER):
        same = text[j:] == text[:-j]
        key[j:] |= np.where(same, classes[:-j].astype(np.int64), BEFORE) << (8 * j)
    return key


class _Sums:
    """Counts by key; what is held is added up whenever it has doubled."""

    def __init__(self):
        self.keys, self.counts, self.n, self.least = [], [], 0, 1 << 20

    def add(self, keys: np.ndarray) -> None:
        codes, distinct = pd.factorize(keys)
        self.keys.append(distinct)
        self.counts.append(np.bincount(codes, minlength=len(distinct)))
        self.n += len(distinct)
        if self.n > 2 * self.least:
            self.settle()
            self.least = max(self.n, 1 << 20)

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        codes, distinct = pd.factorize(np.concatenate(self.keys))
        counts = np.bincount(codes, weights=np.concatenate(self.counts), minlength=len(distinct)).astype(np.int64)
        self.keys, self.counts, self.n = [distinct], [counts], len(distinct)
        return distinct, counts


def _texts(batches: Iterator[pa.RecordBatch], languages: list[str]):
    """Slices of (lang, text, ...) batches: the batch, a range of its rows, their languages' numbers, their bytes and offsets."""
    index = {lang: i for i, lang in enumerate(languages, 1)}
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        number = np.array([*(index.get(x, 0) for x in lang.dictionary.to_pylist()), 0])
        of = number[lang.indices.fill_null(len(lang.dictionary)).to_numpy(zero_copy_only=False)]
        buf, offsets = utf8(batch.column("text"))
        for i, j in slices(offsets):
            at = offsets[i : j + 1]
            yield batch, i, j, of[i:j], buf[at[0] : at[-1]], at - at[0]


def _counted(languages: list[str], alphabets: np.ndarray | None):
    """Symbols (without alphabets) or n-grams with their counts: (lang, key, n), lang being the number of a language."""

    def rows(sums: _Sums) -> pa.RecordBatch:
        keys, counts = sums.settle()
        return pa.RecordBatch.from_arrays([pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for _, _, _, of, buf, offsets in _texts(batches, languages):
            found, text = symbols(buf, offsets)
            lang = of[text]
            keys = found.astype(np.int64) if alphabets is None else ngrams(alphabets[lang, found], text)
            sums.add(keys | lang << 32)
            if sums.n > HELD:
                yield rows(sums)
                sums = _Sums()
        yield rows(sums)

    return run


# the model ---------------------------------------------------------------------------------------------------------------------------------


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off n-grams of count 0, 1, 2 and 3 or more; where the counts of counts give none, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = (float((counts == k).sum()) for k in (1, 2, 3, 4))
    out = np.array([0, 0.5, 1, 1.5])
    if n1 and n2 and n3 and n4:
        y = n1 / (n1 + 2 * n2)
        own = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
        if (own[1:] > 0).all() and (own[1:] < [1, 2, 3]).all():
            out = own
    return out


def hashed(keys: np.ndarray, n: int) -> np.ndarray:
    """A bijection of n-grams of all orders."""
    return mix64(keys.astype(_U) | _U(n << 40))


def estimate(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Counts of distinct ORDER-grams to (hashes, log-probabilities, back-offs) sorted by hash, and the log-probability of an unknown class.

    Lower orders count in how many contexts an n-gram is seen; those that begin before the text have but one and keep their own counts.
    """
    order = np.argsort(keys)
    grams, adjusted = {ORDER: keys[order]}, {ORDER: counts[order].astype(np.float64)}
    for n in range(ORDER - 1, 0, -1):
        suffix = grams[n + 1] & ((1 << 8 * n) - 1)
        grams[n], at = np.unique(suffix, return_inverse=True)
        start = grams[n] >> 8 * (n - 1) == BEFORE
        adjusted[n] = np.where(start, np.bincount(at, weights=adjusted[n + 1]), np.bincount(at))
    found, logs, backs = [], [], []
    below, unknown = None, 0.0
    contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in range(1, ORDER + 1):
        d = discounts(adjusted[n])
        kind = np.minimum(adjusted[n], 3).astype(np.int64)
        context, at = np.unique(grams[n] >> 8, return_inverse=True)
        total = np.bincount(at, weights=adjusted[n])
        gamma = np.bincount(at, weights=d[kind]) / total
        if n == 1:
            lower = np.full(len(grams[1]), 1 / (CLASSES - 1))
            unknown = float(np.log(gamma[0] / (CLASSES - 1)))
        else:
            lower = below[np.searchsorted(grams[n - 1], grams[n] & ((1 << 8 * (n - 1)) - 1))]
            contexts[n - 1] = context, np.log(gamma)
        below = (adjusted[n] - d[kind]) / total[at] + gamma[at] * lower
        found.append(grams[n])
        logs.append(np.log(below))
    for n in range(1, ORDER + 1):
        back = np.zeros(len(grams[n]))
        if n in contexts:
            context, gamma = contexts[n]
            at = np.minimum(np.searchsorted(grams[n], context), len(grams[n]) - 1)
            seen = grams[n][at] == context
            back[at[seen]] = gamma[seen]
            # contexts before a text's first symbol are no n-grams themselves
            found[n - 1] = np.concatenate([grams[n], context[~seen]])
            logs[n - 1] = np.concatenate([logs[n - 1], np.full((~seen).sum(), np.nan)])
            back = np.concatenate([back, gamma[~seen]])
        backs.append(back)
    hashes = np.concatenate([hashed(g, n) for n, g in enumerate(found, 1)])
    order = np.argsort(hashes)
    return hashes[order], np.concatenate(logs)[order].astype(np.float32), np.concatenate(backs)[order].astype(np.float32), unknown


def log_probabilities(keys: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray, float]) -> np.ndarray:
    """The log-probability of the last class of each ORDER-gram after the others."""
    hashes, logs, backs, unknown = model

    def at(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return i, hashes[i] == wanted

    out, open_ = np.zeros(len(keys)), np.arange(len(keys))
    for n in range(ORDER, 0, -1):
        gram = keys[open_] & ((1 << 8 * n) - 1)
        i, seen = at(hashed(gram, n))
        seen &= ~np.isnan(logs[i])
        out[open_[seen]] += logs[i[seen]]
        open_, gram = open_[~seen], gram[~seen]
        if n > 1:
            i, seen = at(hashed(gram >> 8, n - 1))
            out[open_[seen]] += backs[i[seen]]
    out[open_] += unknown
    return out


_MODEL = "lang int, hashes binary, logs binary, backs binary, unknown double, n long"


def _estimated(table: pa.Table) -> pa.Table:
    hashes, logs, backs, unknown = estimate(table.column("key").to_numpy(), table.column("n").to_numpy())
    columns = [pa.array([table.column("lang")[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (hashes, logs, backs)), pa.array([unknown]), pa.array([len(hashes)], pa.int64())]
    return pa.table(columns, names=["lang", "hashes", "logs", "backs", "unknown", "n"])


def top_languages(docs: DataFrame) -> list[str]:
    """The languages with models of their own."""
    return sorted(r.lang for r in docs.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect())


def learn_alphabets(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """[language, symbol]: the class."""
    counted = docs.select("lang", "text").mapInArrow(_counted(languages, None), "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "key"))
    out = np.full((len(languages) + 1, 1 << 16), OTHER, dtype=np.uint8)
    for r in counted.withColumn("place", place).where(F.col("place") <= ALPHABET).collect():  # so many rows a language
        out[r.lang, r.key] = FIRST + r.place - 1
    return out


def learn_models(docs: DataFrame, languages: list[str], alphabets: np.ndarray) -> DataFrame:
    """A stored row for each language with a text: the arrays of its model."""
    counted = docs.select("lang", "text").mapInArrow(_counted(languages, alphabets), "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return stored(counted.groupBy("lang").applyInArrow(_estimated, _MODEL), "models")


_SCORED = "doc_id long, lang int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, alphabets, models = shared.value
        for batch, i, j, of, buf, offsets in _texts(batches, languages):
            base = base_counts(buf, offsets)
            found, text = symbols(buf, offsets)
            lang = of[text]
            codes, distinct = pd.factorize(ngrams(alphabets[lang, found], text) | lang << 32)
            each = np.zeros(len(distinct))
            for k in np.unique(distinct >> 32):
                own = distinct >> 32 == k
                each[own] = log_probabilities(distinct[own] & 0xFFFFFFFF, models[k])
            sums = np.bincount(text, weights=each[codes] if len(codes) else None, minlength=j - i)
            mean = -sums / np.maximum(base["n_words"], 1)
            counts = [pa.array(base[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(of, pa.int32()), *counts, pa.array(mean)], names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"])

    return run


def score(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs (doc_id, lang, text, ...) to a stored table of base counts, the number of the language's model (0: the shared one) and log-perplexity; and the languages."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    spark, languages = docs.sparkSession, top_languages(docs)
    alphabets = learn_alphabets(docs, languages)
    models = learn_models(docs, languages, alphabets)
    sizes = {r.lang: 16 * r.n for r in models.select("lang", "n").collect()}
    groups, room = [], 0
    for k in range(len(languages) + 1):
        size = sizes.get(k, 0)
        if not groups or room < size:
            groups.append([])
            room = MODEL_BYTES
        groups[-1].append(k)
        room -= size
    out = None
    for group in groups:
        arrays = {r.lang: (np.frombuffer(r.hashes, dtype=_U), np.frombuffer(r.logs, dtype=np.float32), np.frombuffer(r.backs, dtype=np.float32), r.unknown) for r in models.where(F.col("lang").isin(group)).collect()}
        own = F.col("lang").isin([languages[k - 1] for k in group if k]) if any(group) else F.lit(False)
        rest = ~F.col("lang").isin(languages) if languages else F.lit(True)
        rows = docs if len(groups) == 1 else docs.where(F.coalesce(own | (rest if 0 in group else F.lit(False)), F.lit(0 in group)))
        shared = spark.sparkContext.broadcast((languages, alphabets, arrays))
        some = stored(rows.mapInArrow(_scored(shared), _SCORED), "scored")
        shared.destroy()
        out = some if out is None else out.unionByName(some)
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))), languages


def _quantiles(values: DataFrame, *shares: float) -> dict[int, list[float]]:
    """(lang, value) to the quantiles of each language, to STEP: from counts of steps, so the same in every run."""
    steps = values.groupBy("lang", F.round(F.col("value") / STEP).cast("long").alias("step")).count()
    # a language's steps are some thousands, however many texts it has
    upto, total = F.sum("count").over(Window.partitionBy("lang").orderBy("step")), F.sum("count").over(Window.partitionBy("lang"))
    ranked = steps.withColumn("upto", upto).withColumn("total", total)
    picks = [F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("step"))).alias(f"q{i}") for i, q in enumerate(shares)]
    return {r[0]: [x * STEP for x in r[1:]] for r in ranked.groupBy("lang").agg(*picks).collect()}


def with_bands(scored: DataFrame) -> DataFrame:
    """scored with lower and upper, the log-perplexities between which a text of its language and length is kept (null for a language without a band)."""
    spark, passed = scored.sparkSession, scored.where("NOT base_failed")
    # a row for each of at most LANGUAGES + 1 models
    middle = {k: q[0] for k, q in _quantiles(passed.select("lang", F.col("log_perplexity").alias("value")), 0.5).items()}
    middles = spark.createDataFrame([(k, middle.get(k)) for k in range(LANGUAGES + 1)], "lang int, middle double")
    scaled = passed.join(F.broadcast(middles), "lang").select("lang", ((F.col("log_perplexity") - F.col("middle")) * F.sqrt("n_words")).alias("value"))
    scale = {k: (q[1] - q[0]) / _QUARTILES for k, q in _quantiles(scaled, 0.25, 0.75).items()}
    facts = spark.createDataFrame([(k, middle.get(k), scale.get(k)) for k in range(LANGUAGES + 1)], "lang int, middle double, scale double")
    reach = F.greatest(F.lit(LEAST_REACH), F.lit(FENCE) * F.col("scale") / F.sqrt(F.greatest("n_words", F.lit(1))))
    reach = F.when(F.col("scale").isNotNull(), reach)
    return scored.join(F.broadcast(facts), "lang").withColumns({"lower": F.col("middle") - reach, "upper": F.col("middle") + reach}).drop("middle", "scale")


def quality(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text, ...) to their counts, base_failed, log-perplexity, its band and kept."""
    out = with_bands(score(docs)[0])
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & inside).drop("lang")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower", "upper")
