"""A corpus pipeline over ``documents``: each stage reads all its predecessor kept and is written as Parquet.

language    documents whose language cannot be told (no letter, or a score below SCORE) go
near_copies one document of each group of near copies stays (the smallest id; of rows that repeat it and its text, one)
benchmark   documents that hold a benchmark item go
mixing      sources are repeated to their target weights
tokens      token shards are written and read back: a row for each document of the mix

All but the last return the columns of ``documents``.  The stages that reject judge and reject rows by id and text together, so null ids are
judged too, and one id on two texts is judged by each text.

Nulls and odd rows, stage by stage: a null or empty text, or one without a letter, has no language and goes; a very long text is judged whole by
every stage.  Rows that repeat id and text are judged alike, but near_copies keeps one of them.  A text without a word is no copy of another and
holds no benchmark item; a null source is a source of its own in the mix; null ids come first in the shards.  Empty tables pass through
all stages.  Columns beyond those of ``documents`` stay until the mix; none of them may be named ``_row``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import decontaminate, jaccard_join, language_id, mixing, token_output
from wakeline.llm.shared import keep_ids, read_table, small, stored

#: How far above chance, of all there is above it, a mean probability must be to be a decision (0.34 with four languages).
SCORE = 0.12


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language; the model learns from the documents that are not held out.

    Where there is nothing to learn from, only texts without a letter go.
    """
    model = language_id.learn(docs)
    if not model["classes"]:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    chance = 1 / len(model["classes"])
    found = language_id.predict(_keyed(docs), model)
    out = found.where((F.col("lang_pred") == language_id.UND) | (F.col("score") < chance + SCORE * (1 - chance)))
    return _without_rows(docs, stored(out.select(F.col("doc_id").alias("_row")).distinct(), "rejected"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id (nulls last) of each component of 5-word shingle similarity of 0.75 or more; of rows that repeat id and text, one."""
    groups = stored(jaccard_join.jaccard_components(_keyed(docs)).select(F.col("doc_id").alias("_row"), "component_id"), "groups")
    several = groups.groupBy("component_id").agg(F.min("_row").alias("a"), F.max("_row").alias("b")).where("a <> b").select("component_id")
    members = stored(groups.join(several.hint("merge"), "component_id", "left_semi").distinct(), "members")
    named = keep_ids(docs.select(_row().alias("_row"), F.col("doc_id").cast("long").alias("doc_id")), members.select("_row"), "_row").distinct()
    members = stored(members.join(named.hint("merge"), "_row"), "named")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))).alias("x")).select(F.col("x._row").alias("_row"))
    out = stored(members.select("_row").join(first.hint("merge"), "_row", "left_anti"), "copies")
    twice = stored(groups.groupBy("_row").count().where("count > 1").select("_row"), "twice")
    kept = _without_rows(docs, out)
    if twice.isEmpty():
        return kept
    again = keep_ids(kept.withColumn("_row", _row()), twice, "_row").dropDuplicates(["_row"]).select(*docs.columns)
    return _without_rows(kept, twice).unionByName(again)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a window that is a benchmark item, or 0.75 of one."""
    found = decontaminate.contaminated(_keyed(docs), read_table(spark, sf_dir, "benchmark"))
    return _without_rows(docs, stored(found.select(F.col("doc_id").alias("_row")).distinct(), "leaks"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token shards."""
    return token_output.token_output(docs)


def _row() -> F.Column:
    """A hash of id and text, never null; a null is told from an empty text and from any id."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the row hash for the id, for operators that only hand the id through."""
    return docs.select(_row().alias("doc_id"), "text")


def _without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows of some row hashes."""
    return _without(docs.withColumn("_row", _row()), rows, "_row").select(*docs.columns)


def _without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without some ids: those are broadcast behind a count, and joined by a shuffle beyond it."""
    return docs.join(F.broadcast(ids) if small(ids) else ids.hint("merge"), key, "left_anti").select(*docs.columns)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("mixing", mix), ("tokens", tokens)]
#: Training, similarity grouping and byte-pair encoding are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
