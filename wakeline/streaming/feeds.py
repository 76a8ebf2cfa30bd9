"""The capture feed: the same functions serve streams and tables.  Event time is ``ts``; late rows go to a table of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.columns import page_key
from ..operators.filters import MIN_CHARS, gate_label
from ..plans.catalog import over_captures, query
from ..sources.captures import captures

LATE = "6 hours"


def read_feed(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """SRC-2: captures from a folder of Parquet files; ts is read as an instant, as watermarks ask for."""
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return feed.withColumn("ts", F.col("ts").cast("timestamp"))


def enough_text() -> Column:
    return F.length(F.trim("ocr_text")) >= MIN_CHARS


def masked_text() -> Column:
    return F.substring(T.redact("ocr_text"), 1, 25_000)


def enriched(feed: DataFrame) -> DataFrame:
    """STR-1: what passes the gate and has enough text, masked, cut and with its page; no state, no shuffle."""
    kept = feed.where((gate_label() == "active") & enough_text())
    return kept.withColumn("ocr_text", masked_text()).withColumn("page_key", page_key())


def once(feed: DataFrame, late: str = LATE) -> DataFrame:
    """STR-14: a capture that is delivered again within the watermark passes once; the state ends with the watermark."""
    if feed.isStreaming:
        return feed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "capture_id"])
    return feed.dropDuplicates(["user_id", "capture_id"])


def counts_by_hour(feed: DataFrame, late: str = LATE) -> DataFrame:
    """STR-13: captures of each app and hour; a stream gives an hour once its watermark has passed."""
    df = feed.withWatermark("ts", late) if feed.isStreaming else feed
    return df.groupBy(F.window("ts", "1 hour").alias("w"), "app").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "app", "n")


def page_sessions(feed: DataFrame, gap: str = "20 minutes", late: str = LATE, least: int = 2) -> DataFrame:
    """STR-12: visits of a page with gaps below a bound; a visit elsewhere in between does not end one."""
    df = feed.withWatermark("ts", late) if feed.isStreaming else feed
    s = df.groupBy("user_id", "page_key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return s.where(F.col("n") >= least).select("user_id", "page_key", F.col("w.start").alias("first_ts"), "last_ts", "n")


def above_mark(df: DataFrame, mark: int | None, key: str = "capture_id") -> DataFrame:
    """STR-6 over a table: rows above the stored mark; without one, those of the newest day."""
    if mark is not None:
        return df.where(F.col(key) > mark)
    newest = df.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("since"))
    return df.join(F.broadcast(newest), F.col("ts") >= F.col("since")).drop("since")  # one row is broadcast


def sweep(feed: DataFrame, path: str, checkpoint: str) -> None:
    """STR-6 over a stream: everything new since the last call is appended once; the checkpoint holds the mark."""
    feed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query("hourly_counts", over_captures("SELECT date_trunc('hour', ts) AS hour, app, count(*) AS n FROM captures_v GROUP BY 1, 2"))
def hourly_counts(spark, sf_dir) -> DataFrame:
    return counts_by_hour(captures(spark, sf_dir))


@query("page_sessions", over_captures(
    "SELECT user_id, page_key, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id, page_key ORDER BY ts, capture_id) AS s FROM (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER (PARTITION BY user_id, page_key ORDER BY ts, capture_id), ts) <= 43200 THEN 0 ELSE 1 END AS nw FROM keyed)) GROUP BY user_id, page_key, s HAVING count(*) >= 2"
))
def page_sessions_q(spark, sf_dir) -> DataFrame:
    """STR-12 with a gap of 12 hours, as the fixtures' gaps are hours."""
    return page_sessions(captures(spark, sf_dir, keyed=True), gap="12 hours")


@query("swept", over_captures("SELECT capture_id FROM captures_v WHERE ts >= (SELECT max(ts) FROM captures_v) - INTERVAL 1 DAY"))
def swept(spark, sf_dir) -> DataFrame:
    """STR-6, first run."""
    return above_mark(captures(spark, sf_dir), None).select("capture_id")


@query("enriched_captures")
def enriched_captures(spark, sf_dir) -> DataFrame:
    """STR-1 over the table; captures share documents, so a text is judged and masked once."""
    df = captures(spark, sf_dir, text=True, made={"ocr_text": masked_text(), "enough": enough_text()})
    return df.where(gate_label() == "active").where("enough").drop("enough").withColumn("page_key", page_key())
