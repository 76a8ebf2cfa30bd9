"""Page versions, numeric series, query log and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import over_captures, query
from ..sources.captures import captures, table
from .sessions import seconds


def neighbours(df: DataFrame) -> DataFrame:
    """JN-2: the nearest captures of other pages, 90 minutes away at most; islands of one page, then the rows beside them."""
    w = Window.partitionBy("user_id").orderBy("ts", "capture_id")
    df = df.withColumn("new", (~F.col("page_key").eqNullSafe(F.lag("page_key").over(w))).cast("int")).withColumn("island", F.sum("new").over(w))
    before = F.when(F.col("new") == 1, F.struct(F.lag("page_key").over(w).alias("k"), F.lag("ts").over(w).alias("t")))
    after = F.when(F.lead("new").over(w) == 1, F.struct(F.lead("page_key").over(w).alias("k"), F.lead("ts").over(w).alias("t")))
    df = df.withColumn("before", before).withColumn("after", after)
    own = Window.partitionBy("user_id", "island")
    df = df.withColumn("p", F.first("before", ignorenulls=True).over(own)).withColumn("x", F.first("after", ignorenulls=True).over(own))
    df = df.select("capture_id", "ts", F.col("p.k").alias("pk"), F.col("p.t").alias("pt"), F.col("x.k").alias("nk"), F.col("x.t").alias("nt"))
    return df.select("capture_id", F.when(seconds("pt", "ts") <= 5400, F.col("pk")).alias("prev_key"), F.when(seconds("ts", "nt") <= 5400, F.col("nk")).alias("next_key"))


@query("page_neighbours", over_captures(
    "SELECT capture_id, CASE WHEN date_diff('second', p_ts, ts) <= 5400 THEN p_key END AS prev_key, CASE WHEN date_diff('second', ts, n_ts) <= 5400 THEN n_key END AS next_key FROM (SELECT k.capture_id, k.ts, "
    "(SELECT arg_max(o.page_key, (o.ts, o.capture_id)) FROM keyed o WHERE o.user_id = k.user_id AND o.page_key <> k.page_key AND (o.ts, o.capture_id) < (k.ts, k.capture_id)) AS p_key, (SELECT max(o.ts) FROM keyed o WHERE o.user_id = k.user_id AND o.page_key <> k.page_key AND (o.ts, o.capture_id) < (k.ts, k.capture_id)) AS p_ts, "
    "(SELECT arg_min(o.page_key, (o.ts, o.capture_id)) FROM keyed o WHERE o.user_id = k.user_id AND o.page_key <> k.page_key AND (o.ts, o.capture_id) > (k.ts, k.capture_id)) AS n_key, (SELECT min(o.ts) FROM keyed o WHERE o.user_id = k.user_id AND o.page_key <> k.page_key AND (o.ts, o.capture_id) > (k.ts, k.capture_id)) AS n_ts FROM keyed k)"
))
def page_neighbours(spark, sf_dir) -> DataFrame:
    return neighbours(captures(spark, sf_dir, keyed=True))


@query("rare_pages", over_captures("SELECT capture_id FROM (SELECT capture_id, count(*) OVER (PARTITION BY user_id, page_key) AS c FROM keyed) WHERE c <= 3"))
def rare_pages(spark, sf_dir) -> DataFrame:
    """JN-20: captures whose page was seen three times at most."""
    return captures(spark, sf_dir, keyed=True).withColumn("c", F.count("*").over(Window.partitionBy("user_id", "page_key"))).where("c <= 3").select("capture_id")


_SERIES = "s AS (SELECT concat(user_id, '::', event_type) AS key, value, CASE WHEN event_id % 10 < 3 THEN '' ELSE 'ms' END AS unit, ts, event_id FROM events)"


def series(spark, sf_dir) -> DataFrame:
    unit = F.when(F.col("event_id") % 10 < 3, "").otherwise("ms")
    return table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("::"), "event_type").alias("key"), "value", unit.alias("unit"), "ts", "event_id")


@query("promoted_series", f"WITH {_SERIES} SELECT key, count(DISTINCT ts) AS n, min(value) AS low, max(value) AS high FROM s GROUP BY 1 HAVING count(DISTINCT ts) >= 3 AND max(value) > min(value)")
def promoted_series(spark, sf_dir) -> DataFrame:
    """AGG-8."""
    return series(spark, sf_dir).groupBy("key").agg(F.countDistinct("ts").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).where("n >= 3 AND high > low")


@query("established_unit", f"WITH {_SERIES} SELECT key, unit FROM (SELECT key, unit, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, unit) AS r FROM s WHERE unit <> '' GROUP BY 1, 2) WHERE r = 1")
def established_unit(spark, sf_dir) -> DataFrame:
    """AGG-9: the most frequent unit, ties to the smaller name."""
    n = series(spark, sf_dir).where("unit <> ''").groupBy("key", "unit").agg(F.count("*").alias("n"))
    return n.groupBy("key").agg(F.min_by("unit", F.struct(-F.col("n"), F.col("unit"))).alias("unit"))


@query("without_outliers", f"WITH {_SERIES}, m AS (SELECT key, median(value) AS med, count(*) AS n FROM s GROUP BY 1), d AS (SELECT s.key, median(abs(s.value - m.med)) AS mad FROM s JOIN m USING (key) GROUP BY 1) SELECT s.key, s.event_id, s.value FROM s JOIN m USING (key) JOIN d USING (key) WHERE n < 4 OR mad = 0 OR abs(value - med) <= 6 * mad")
def without_outliers(spark, sf_dir) -> DataFrame:
    """AGG-10: points within six median absolute deviations of the median, from four points on."""
    s = series(spark, sf_dir)
    m = s.groupBy("key").agg(F.median("value").alias("med"), F.count("*").alias("n"))
    s = s.join(m, "key")
    d = s.groupBy("key").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    return s.join(d, "key").where("n < 4 OR mad = 0 OR abs(value - med) <= 6 * mad").select("key", "event_id", "value")


@query("retention", over_captures("SELECT capture_id FROM captures_v WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY AND (ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY OR capture_id % 11 = 0)"))
def retention(spark, sf_dir) -> DataFrame:
    """STR-7: what stays when old rows go, except recalled ones, and very old rows go regardless (10 and 20 days here)."""
    df = captures(spark, sf_dir)
    recalled = df.where("capture_id % 11 = 0").select("capture_id", F.lit(True).alias("recalled"))
    keep = "ts >= timestamp_ntz'2024-01-31' - INTERVAL 20 DAY AND (ts >= timestamp_ntz'2024-01-31' - INTERVAL 10 DAY OR recalled)"
    return df.join(recalled, "capture_id", "left").where(keep).select("capture_id")


@query("days_without_sessions", over_captures("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM captures_v WHERE ts < TIMESTAMP '2024-01-17' EXCEPT SELECT DISTINCT user_id, CAST(ts AS DATE) FROM captures_v WHERE app = 'Notes'"))
def days_without_sessions(spark, sf_dir) -> DataFrame:
    """JN-6: days older than 14 days with captures but none in the derived table (here: notes)."""
    df = captures(spark, sf_dir).withColumn("day", F.to_date("ts"))
    done = df.where("app = 'Notes'").select("user_id", "day").distinct()
    return df.where("ts < timestamp_ntz'2024-01-17'").select("user_id", "day").distinct().join(done, ["user_id", "day"], "left_anti")
