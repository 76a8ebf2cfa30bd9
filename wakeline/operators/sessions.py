"""Time on apps and pages, sessions, transitions: one window per user and day, then aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import host_of
from ..plans.catalog import over_captures, query
from ..sources.captures import captures, table

DWELL_CAP = 300
MIN_DWELL = 60
MOST_PLACES = 18
SESSION_GAP = 20 * 60


def seconds(a: str, b: str) -> Column:
    """Whole seconds from timestamp a to b."""
    return F.expr(f"unix_timestamp(cast({b} AS timestamp)) - unix_timestamp(cast({a} AS timestamp))")


def with_dwell(df: DataFrame, least: int | None = None) -> DataFrame:
    """WIN-2: the gap to the user's next capture of the day, capped; the last of a day earns 0."""
    w = Window.partitionBy("user_id", "day").orderBy("ts", "capture_id")
    df = df.withColumn("day", F.to_date("ts")).withColumn("next_ts", F.lead("ts").over(w))
    gap = F.when(F.col("next_ts").isNotNull(), F.least(seconds("ts", "next_ts"), F.lit(DWELL_CAP)))  # least passes over nulls
    return df.withColumn("dwell", F.coalesce(gap if least is None else F.when(gap.isNotNull(), F.greatest(gap, F.lit(least))), F.lit(0)))


def time_per_app(df: DataFrame) -> DataFrame:
    return with_dwell(df).groupBy("user_id", "day", "app").agg(F.sum("dwell").alias("secs")).withColumn("minutes", F.bround(F.col("secs") / 60).cast("long"))


_DWELL = "SELECT * EXCLUDE (next_ts), CASE WHEN next_ts IS NULL THEN 0 ELSE least(date_diff('second', ts, next_ts), 300) END AS dwell FROM (SELECT *, CAST(ts AS DATE) AS day, lead(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, capture_id) AS next_ts FROM keyed)"
_TIME = f"d AS ({_DWELL}), t AS (SELECT user_id, day, app, sum(dwell)::BIGINT AS secs, round_even(sum(dwell) / 60.0, 0)::BIGINT AS minutes FROM d GROUP BY 1, 2, 3)"


@query("time_report", over_captures("SELECT * FROM t", _TIME))
def time_report(spark, sf_dir) -> DataFrame:
    """AGG-3: minutes per user, day and app."""
    return time_per_app(captures(spark, sf_dir))


@query("weekly_report", over_captures("SELECT user_id, app, sum(secs)::BIGINT AS secs, sum(minutes)::BIGINT AS minutes, count(*) AS days FROM t WHERE day > DATE '2024-01-24' AND day <= DATE '2024-01-31' GROUP BY 1, 2", _TIME))
def weekly_report(spark, sf_dir) -> DataFrame:
    """AGG-4: the week's totals per app; the week is filtered before the window."""
    week = captures(spark, sf_dir).where("ts >= timestamp_ntz'2024-01-25' AND ts < timestamp_ntz'2024-02-01'")
    return time_per_app(week).groupBy("user_id", "app").agg(F.sum("secs").alias("secs"), F.sum("minutes").alias("minutes"), F.count("*").alias("days"))


@query("capture_stats", over_captures(
    "SELECT user_id, kind, name, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY n DESC, name) AS rank FROM (SELECT user_id, 'app' AS kind, app AS name, count(*) AS n FROM captures_v WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1, 3 "
    "UNION ALL SELECT user_id, 'host', regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', ''), count(*) FROM captures_v WHERE url IS NOT NULL AND ts >= TIMESTAMP '2024-01-01' GROUP BY 1, 3)) WHERE rank <= 15"
))
def capture_stats(spark, sf_dir) -> DataFrame:
    """AGG-1: each user's 15 most captured apps and hosts of 30 days."""
    df = captures(spark, sf_dir).where("ts >= timestamp_ntz'2024-01-01'")
    both = F.explode(F.array(F.struct(F.lit("app").alias("kind"), F.col("app").alias("name")), F.struct(F.lit("host").alias("kind"), host_of().alias("name"))))
    n = df.select("user_id", both.alias("x")).select("user_id", "x.*").where("name IS NOT NULL").groupBy("user_id", "kind", "name").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("user_id", "kind").orderBy(F.desc("n"), "name"))).where("rank <= 15")


@query("status", over_captures("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-30') AS today, min(ts) AS oldest, max(ts) AS latest FROM captures_v GROUP BY 1"))
def status(spark, sf_dir) -> DataFrame:
    """AGG-2."""
    return captures(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.to_date("ts") == F.lit("2024-01-30").cast("date")).alias("today"), F.min("ts").alias("oldest"), F.max("ts").alias("latest"))


def place_stats(df: DataFrame) -> DataFrame:
    """AGG-5: dwell and visits of each place of a user's day; those of a minute or more, 18 at most, else the first three."""
    p = with_dwell(df, least=0).groupBy("user_id", "day", "page_key").agg(F.sum("dwell").alias("dwell"), F.count("*").alias("visits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    w = Window.partitionBy("user_id", "day")
    p = p.withColumn("place", F.row_number().over(w.orderBy(F.desc("dwell"), "first_ts", "page_key"))).withColumn("full", F.max((F.col("dwell") >= MIN_DWELL).cast("int")).over(w))
    return p.where(F.when(F.col("full") == 1, (F.col("dwell") >= MIN_DWELL) & (F.col("place") <= MOST_PLACES)).otherwise(F.col("place") <= 3)).drop("full")


_PLACES = f"d AS ({_DWELL}), p0 AS (SELECT user_id, day, page_key, sum(greatest(dwell, 0))::BIGINT AS dwell, count(*) AS visits, min(ts) AS first_ts, max(ts) AS last_ts FROM d GROUP BY 1, 2, 3), p1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY dwell DESC, first_ts, page_key) AS place, max(dwell) OVER (PARTITION BY user_id, day) AS top FROM p0), places AS (SELECT user_id, day, page_key, dwell, visits, first_ts, last_ts, place FROM p1 WHERE CASE WHEN top >= 60 THEN dwell >= 60 AND place <= 18 ELSE place <= 3 END)"


@query("day_places", over_captures("SELECT * FROM places", _PLACES))
def day_places(spark, sf_dir) -> DataFrame:
    """AGG-5."""
    return place_stats(captures(spark, sf_dir, keyed=True))


def attention_trace(df: DataFrame) -> DataFrame:
    """WIN-3: the change points among a day's kept places, with the place left."""
    kept = place_stats(df).select("user_id", "day", "page_key")
    w = Window.partitionBy("user_id", "day").orderBy("ts", "capture_id")
    t = df.withColumn("day", F.to_date("ts")).join(kept, ["user_id", "day", "page_key"], "left_semi").withColumn("left_key", F.lag("page_key").over(w))
    return t.where(~F.col("page_key").eqNullSafe(F.col("left_key"))).select("user_id", "day", "capture_id", "ts", "page_key", "left_key")


_TRACE = _PLACES + ", t0 AS (SELECT d.user_id, d.day, d.capture_id, d.ts, d.page_key, lag(d.page_key) OVER (PARTITION BY d.user_id, d.day ORDER BY d.ts, d.capture_id) AS left_key FROM d SEMI JOIN places p ON p.user_id = d.user_id AND p.day = d.day AND p.page_key = d.page_key), trace AS (SELECT * FROM t0 WHERE page_key IS DISTINCT FROM left_key)"


@query("attention_trace", over_captures("SELECT * FROM trace", _TRACE))
def attention_trace_q(spark, sf_dir) -> DataFrame:
    return attention_trace(captures(spark, sf_dir, keyed=True))


@query("place_edges", over_captures("SELECT user_id, day, least(page_key, left_key) AS a, greatest(page_key, left_key) AS b, count(*) AS weight FROM trace WHERE left_key IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2", _TRACE))
def place_edges(spark, sf_dir) -> DataFrame:
    """AGG-6: undirected switches between places, walked twice or more."""
    t = attention_trace(captures(spark, sf_dir, keyed=True)).where("left_key IS NOT NULL")
    return t.groupBy("user_id", "day", F.least("page_key", "left_key").alias("a"), F.greatest("page_key", "left_key").alias("b")).agg(F.count("*").alias("weight")).where("weight >= 2")


@query("day_totals", over_captures("SELECT user_id, day, count(*) AS captures, count(DISTINCT page_key) AS pages, round_even(sum(dwell) / 60.0, 0)::BIGINT AS minutes FROM d GROUP BY 1, 2", f"d AS ({_DWELL})"))
def day_totals(spark, sf_dir) -> DataFrame:
    """AGG-7."""
    return with_dwell(captures(spark, sf_dir, keyed=True)).groupBy("user_id", "day").agg(F.count("*").alias("captures"), F.countDistinct("page_key").alias("pages"), F.bround(F.sum("dwell") / 60).cast("long").alias("minutes"))


def with_sessions(df: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """WIN-1: df with session: a user's sessions end at a long gap or a change of page.

    Gaps and changes are found inside days and stitched at midnight from one row a day, so a user's history is never in one task: a session's number is
    those that began on earlier days and so far on its own.
    """
    w = Window.partitionBy("user_id", "day").orderBy("ts", "capture_id")
    d = df.withColumn("day", F.to_date("ts")).withColumn("_last", F.lag(F.struct("ts", "page_key")).over(w))
    ends = d.groupBy("user_id", "day").agg(F.max(F.struct("ts", "capture_id", "page_key")).alias("e"))
    before = ends.select("user_id", "day", F.lag("e").over(Window.partitionBy("user_id").orderBy("day")).alias("_e"))
    d = d.join(before.hint("merge"), ["user_id", "day"]).withColumn("_last", F.coalesce("_last", F.when(F.col("_e").isNotNull(), F.struct(F.col("_e.ts").alias("ts"), F.col("_e.page_key").alias("page_key"))))).withColumn("_last_ts", F.col("_last.ts"))
    new = F.col("_last").isNull() | (seconds("_last_ts", "ts") > gap) | ~F.col("page_key").eqNullSafe(F.col("_last.page_key"))
    d = d.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long"))
    begun = d.groupBy("user_id", "day").agg(F.sum("_new").alias("n"))
    past = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select("user_id", "day", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_past"))
    d = d.join(begun.hint("merge"), ["user_id", "day"]).withColumn("session", F.col("_past") + F.sum("_new").over(w))
    return d.select(*df.columns, "session")


def sessionize(df: DataFrame, gap: int = SESSION_GAP, least: int = 2) -> DataFrame:
    """WIN-1: sessions of two captures or more: (user_id, session, page_key, n, first_id, span_start, span_end)."""
    s = with_sessions(df, gap)
    return s.groupBy("user_id", "session", "page_key").agg(F.count("*").alias("n"), F.min("capture_id").alias("first_id"), F.min("ts").alias("span_start"), F.max("ts").alias("span_end")).where(F.col("n") >= least)


def _sessions_sql(gap: int) -> str:
    w = "OVER (PARTITION BY user_id ORDER BY ts, capture_id)"
    return f"s0 AS (SELECT *, CASE WHEN lag(ts) {w} IS NULL OR date_diff('second', lag(ts) {w}, ts) > {gap} OR page_key IS DISTINCT FROM lag(page_key) {w} THEN 1 ELSE 0 END AS nw FROM keyed), s1 AS (SELECT *, (sum(nw) {w})::BIGINT AS session FROM s0)"


@query("sessions", over_captures("SELECT user_id, session, page_key, count(*) AS n, min(capture_id) AS first_id, min(ts) AS span_start, max(ts) AS span_end FROM s1 GROUP BY 1, 2, 3 HAVING count(*) >= 2", _sessions_sql(43200)))
def sessions(spark, sf_dir) -> DataFrame:
    """WIN-1 with a gap of 12 hours, as the fixtures' gaps are hours."""
    return sessionize(captures(spark, sf_dir, keyed=True), gap=12 * 3600)


@query("latest_per_page", over_captures("SELECT user_id, page_key, capture_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, page_key ORDER BY ts DESC, capture_id DESC) AS r FROM keyed) WHERE r = 1"))
def latest_per_page(spark, sf_dir) -> DataFrame:
    """WIN-4: one aggregate, no sort."""
    top = F.max(F.struct("ts", "capture_id")).alias("x")
    return captures(spark, sf_dir, keyed=True).groupBy("user_id", "page_key").agg(top).select("user_id", "page_key", "x.capture_id", "x.ts")


@query("recent_titles", over_captures("SELECT user_id, title, last_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_id DESC) AS r FROM (SELECT user_id, coalesce(nullif(window_title, ''), app) AS title, max(capture_id) AS last_id FROM captures_v GROUP BY 1, 2)) WHERE r <= 6"))
def recent_titles(spark, sf_dir) -> DataFrame:
    """AGG-21."""
    t = captures(spark, sf_dir).groupBy("user_id", F.coalesce(F.nullif("window_title", F.lit("")), "app").alias("title")).agg(F.max("capture_id").alias("last_id"))
    return t.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last_id")))).where("r <= 6").drop("r")


@query("rolling_day_count", over_captures("SELECT capture_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM captures_v"))
def rolling_day_count(spark, sf_dir) -> DataFrame:
    """WIN-11: a user's captures of the last 24 hours."""
    at = F.expr("unix_timestamp(cast(ts AS timestamp))")
    return captures(spark, sf_dir).select("capture_id", F.count("*").over(Window.partitionBy("user_id").orderBy(at).rangeBetween(-86400, 0)).alias("n"))


@query("chat_sessions", """WITH c AS (SELECT *, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn * (9 + conv_id % 20)) AS ts FROM conversations),
 g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL OR date_diff('second', lag(ts) OVER (PARTITION BY conv_id ORDER BY turn), ts) > 1200 THEN 1 ELSE 0 END AS nw FROM c),
 s AS (SELECT *, (sum(nw) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS session FROM g) SELECT conv_id, session, count(*) AS n, min(turn) AS first_turn FROM s GROUP BY 1, 2""")
def chat_sessions(spark, sf_dir) -> DataFrame:
    """WIN-6: chats split where messages are more than 20 minutes apart."""
    ts = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, conv_id, turn * (9 + conv_id % 20), 0)")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", ts.alias("ts")).withColumn("last_ts", F.lag("ts").over(w))
    c = c.withColumn("new", (F.col("last_ts").isNull() | (seconds("last_ts", "ts") > SESSION_GAP)).cast("int")).withColumn("session", F.sum("new").over(w))
    return c.groupBy("conv_id", "session").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))
