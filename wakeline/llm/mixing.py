"""Operator 2, mixing sources to target weights, in DataFrame functions only.

Words per source are aggregated, targets are set by water filling, and a source's repetition rate is its target over
its size.  Each document goes out floor(rate) times, and once more with a probability of the rate's fraction: the
Bernoulli draw is the first 32 bits of md5(doc_id), so reruns and retried tasks agree.

A source's taken words deviate from its target by about the square root of the sum of size squared times f (1 - f), f being the fraction of its rate.

Nulls: a null text has 0 words; a null source is a source of its own, last in order; a null id draws as the text 'null'.
A source without words has the target 0 and rate 0.  Rows that repeat an id draw alike.  An empty table gives an empty
mix.  Other columns of the documents pass through :func:`mix_sources`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, stored

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Sources are joined by broadcast up to this count; beyond it the join is salted.
BROADCAST_SOURCES = 10_000
SALTS = 64


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """sized (source, size, ...) to (source, source_size, target): one row per source.

    A target is min(3 * size, weight * level), with the one level at which all targets sum to all sizes.  With the
    sources sorted by 3 * size / weight, those before the first whose cap lies above the level are the capped ones.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # pre-aggregated: one row a source from here on, ranked and filled in one task (it sorts on disk where memory is short)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * MOST_REPEATS).withColumn("ratio", F.col("cap") / F.col("weight"))
    ordered = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("shares", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("rest") / F.col("shares")).withColumn("capped", F.col("ratio") <= F.col("level"))
    s = s.withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """docs with source_size, target and copies: how often the mix takes each document.

    The sources are counted first: up to BROADCAST_SOURCES they are broadcast, so a source with a third of all rows stays
    where it is; beyond that, each source is spread over SALTS keys.
    """
    targets = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("source_size"), "target")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(targets), same)
    else:
        spread = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn("_of", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread.hint("merge"), same & (F.col("_of") == F.col("_salt"))).drop("_of", "_salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return joined.withColumn("copies", F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).drop("_source")


def mix_sources(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, ...) repeated to the target weights; same columns."""
    sized = docs.select("source", word_count().alias("size"))
    targets = stored(source_targets(sized), "targets")
    inner = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source")
    copies = with_copies(inner, targets).where("copies > 0")
    return copies.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"))
    sized = stored(docs, "sized")
    mixed = with_copies(sized, stored(source_targets(sized), "targets"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * z AS cap, CAST(3 * z AS DOUBLE) / w AS ratio FROM s),
f AS (SELECT *, CAST((SELECT sum(z) FROM s) - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST((SELECT sum(w) FROM s) - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS lvl
      FROM o WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, z, CASE WHEN ratio <= lvl THEN CAST(cap AS DOUBLE) ELSE (SELECT max(lvl) FROM f WHERE ratio > lvl) * w END AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.z, t.target, CASE WHEN t.z > 0 THEN t.target / t.z ELSE 0 END AS rate,
      CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z AS source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
