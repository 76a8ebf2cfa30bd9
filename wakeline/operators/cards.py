"""Cards and lookups: clean titles, shared prefixes, thread lines, moment cards, pinned answers, settled sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, dot
from ..plans.catalog import over_captures, query
from ..sources.captures import captures, query_log, table
from .filters import UNPINNABLE
from .history import neighbours
from .memory import site_key
from .threads import salient_lines
from .tiles import vector_search

# What clutters a title, and how long a site's name and a profile's name may be.
COUNTER = r"(?:^|(?<=\s)|(?<=:))\s*[\(\[]\s*\d{1,5}\s*[\)\]](?=\s|$)"
OUTER_COUNTER = r"^\s*[\(\[]\s*\d+\s*[\)\]]\s*|\s*[\(\[]\s*\d+\s*[\)\]]\s*$"
SITE_SUFFIX = r"\s+[-–—|]\s+[A-Za-z][A-Za-z.\s]{0,20}$"
PREFIX = r"^([^\s:][^:]{0,14}):\s+"
BULLET, CARRIED = r"^\s*[-*•]\s+", r"(?i)\*?\(?\s*carried (?:over )?from [^)*]+\)?\*?\s*"
LEAST_TITLE, LEAST_LABEL, LEAST_THREAD = 6, 3, 8
PIN_LEAST = 0.80


def clean_title(title: str | Column) -> Column:
    """TXT-15: a title without counters anywhere and without the site's name behind it; a cut that would leave a bracket open is not made."""
    t = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(col(title), F.lit("")), r"\s+", " ")), COUNTER, " ")
    t = F.regexp_replace(F.regexp_replace(t, OUTER_COUNTER, ""), r"\s{2,}", " ")
    t = F.regexp_replace(t, r"^[ ,·|–—…-]+|[ ,·|–—…-]+$", "")
    cut = F.trim(F.regexp_replace(t, SITE_SUFFIX, ""))
    balanced = F.length(F.translate(cut, "(", "")) == F.length(F.translate(cut, ")", ""))
    return F.when((F.length(cut) >= LEAST_TITLE) & balanced, cut).otherwise(t)


def shortened(text: str | Column, limit: int) -> Column:
    """TXT-15: a text cut at a word's end, with an ellipsis; a first word that is too long is cut inside."""
    t = col(text)
    head = F.left(t, F.lit(limit))
    words = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.when(F.length(words) >= 0.6 * limit, words).otherwise(head), r"[ ,\-–—|]+$", ""), F.lit("…")))


def without_shared_prefix(places: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """TXT-17: labels without a ``Name: `` that two places or more of a group share, where something of three letters is left."""
    p = places.withColumn("_prefix", F.nullif(F.regexp_extract(label, PREFIX, 1), F.lit("")))
    shared = p.where("_prefix IS NOT NULL").groupBy(*by, "_prefix").agg(F.count("*").alias("_n")).where("_n >= 2")
    rest = F.trim(F.regexp_replace(label, PREFIX, ""))
    p = p.join(shared.hint("merge"), [*by, "_prefix"], "left")
    return p.withColumn(label, F.when(F.col("_n").isNotNull() & (F.length(rest) >= LEAST_LABEL), rest).otherwise(F.col(label))).select(*places.columns)


def thread_lines(text: str = "text") -> Column:
    """TXT-18: the bullets of a text without their marks and "carried from" notes; "none" and short lines go."""
    bullets = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike(BULLET))
    lines = F.transform(bullets, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, BULLET, ""), CARRIED, "")))
    return F.filter(lines, lambda x: (F.length(x) >= LEAST_THREAD) & (F.lower(F.regexp_replace(x, r"\.+$", "")) != "none"))


def moment_cards(moments: DataFrame, df: DataFrame, lines: int = 6) -> DataFrame:
    """GRA-5: moments (user_id, page_key, at) with the page's latest capture up to then, the lines that say most, and the pages before and after it."""
    known = df.select("user_id", "page_key", "ts", "capture_id").join(moments.hint("merge"), ["user_id", "page_key"]).where("ts <= at")
    last = known.groupBy("user_id", "page_key", "at").agg(F.max(F.struct("ts", "capture_id")).alias("x")).select("user_id", "page_key", "at", "x.ts", "x.capture_id")
    text = df.select("capture_id", salient_lines("ocr_text", lines).alias("lines"))
    return last.join(text.hint("merge"), "capture_id").join(neighbours(df).hint("merge"), "capture_id")


def pinned_answers(questions: DataFrame, pins: DataFrame) -> DataFrame:
    """JN-5: (query_id, pin_id, score): the user's pin nearest to each question that may be pinned; ties to the smaller id."""
    both = lambda df, key: df.withColumn("_len", F.sqrt(dot("embedding", "embedding"))).where("_len > 0").groupBy("user_id", F.transform("embedding", lambda x: x / F.nullif(F.col("_len"), F.lit(0.0))).alias("v")).agg(F.min(key).alias("key"))
    asked = questions.where(~F.col("text").rlike(UNPINNABLE)).select("query_id", "user_id", "embedding")
    unit = asked.withColumn("_len", F.sqrt(dot("embedding", "embedding"))).where("_len > 0").select("query_id", "user_id", F.transform("embedding", lambda x: x / F.nullif(F.col("_len"), F.lit(0.0))).alias("v"))
    # equal vectors have the same pin: one question, and the pin of the smallest id, stand for them
    q, p = both(asked, "query_id"), both(pins, "pin_id")
    found = vector_search(q.select(F.col("key").alias("query_id"), F.col("user_id").alias("owner"), "v"), p.select("key", F.col("user_id").alias("owner"), F.lit(0).cast("long").alias("t"), "v"), 1, least=PIN_LEAST)
    best = q.join(found.select(F.col("query_id").alias("key"), F.col("key").alias("pin_id"), "score").hint("merge"), "key").select("user_id", "v", "pin_id", "score")
    return unit.join(best.hint("merge"), ["user_id", "v"]).select("query_id", "pin_id", "score")


def settled_sites(log: DataFrame, owners: DataFrame) -> DataFrame:
    """JN-17: log (user_id, site, owner, at) to each site's last owner, where that owner is still one of owners (owner)."""
    last = log.groupBy("user_id", "site").agg(F.max(F.struct("at", "owner")).alias("x")).select("user_id", "site", "x.owner")
    return last.join(owners.select("owner").distinct().hint("merge"), "owner", "left_semi").select("user_id", "site", "owner")




@query("clean_titles", over_captures("SELECT capture_id, CASE WHEN app = 'Browser' THEN regexp_extract(window_title, 'Page [0-9]+') ELSE app || ' item ' || CAST(capture_id % 3 AS VARCHAR) END AS title FROM captures_v"))
def clean_titles(spark, sf_dir) -> DataFrame:
    """TXT-15 over titles with the name of a site behind them."""
    return captures(spark, sf_dir).select("capture_id", clean_title(F.concat("window_title", F.lit(" - Example Site"))).alias("title"))


@query("unprefixed_labels", over_captures("SELECT user_id, page_key, CASE WHEN n >= 2 THEN page_key ELSE prefix || ': ' || page_key END AS label FROM (SELECT *, count(*) OVER (PARTITION BY user_id, prefix) AS n FROM (SELECT DISTINCT user_id, page_key, 'Space ' || CAST(length(page_key) % 7 AS VARCHAR) AS prefix FROM keyed))"))
def unprefixed_labels(spark, sf_dir) -> DataFrame:
    """TXT-17: pages named after one of seven spaces."""
    p = captures(spark, sf_dir, keyed=True).select("user_id", "page_key").distinct()
    label = F.concat(F.lit("Space "), (F.length("page_key") % 7).cast("string"), F.lit(": "), F.col("page_key"))
    return without_shared_prefix(p.withColumn("label", label), ["user_id"])


@query("thread_lines", "SELECT conv_id, turn, trim(string_split(text, chr(10))[1]) AS line FROM conversations WHERE length(trim(string_split(text, chr(10))[1])) >= 8")
def thread_lines_q(spark, sf_dir) -> DataFrame:
    """TXT-18 over turns written as bullets, with notes and empty threads between."""
    md = F.concat(F.lit("## Threads\n- none.\n* (carried from Monday) "), F.col("text"), F.lit("\n• short\n- None"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", md.alias("text")).select("conv_id", "turn", F.explode(thread_lines()).alias("line"))


@query("moment_cards", over_captures("SELECT k.user_id, k.page_key, max(k.ts) AS ts, arg_max(k.capture_id, (k.ts, k.capture_id)) AS capture_id FROM keyed k WHERE k.ts <= TIMESTAMP '2024-01-20' GROUP BY 1, 2"))
def moment_cards_q(spark, sf_dir) -> DataFrame:
    """GRA-5 for every page as it was known on 20 January; lines and neighbours have queries of their own."""
    df = captures(spark, sf_dir, text=True, keyed=True)
    moments = captures(spark, sf_dir, keyed=True).select("user_id", "page_key", F.expr("timestamp_ntz'2024-01-20'").alias("at")).distinct()
    return moment_cards(moments, df).select("user_id", "page_key", "ts", "capture_id")


@query("pinned_answers", over_captures(
    f"SELECT query_id, pin_id, score FROM (SELECT q.query_id, p.query_id AS pin_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM queries_v q JOIN queries_v p USING (user_id) WHERE p.query_id % 4 = 0 AND NOT regexp_matches(q.text, '{UNPINNABLE}')) WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pin_id) = 1"))
def pinned_answers_q(spark, sf_dir) -> DataFrame:
    """JN-5: every fourth question stands for a pin."""
    log = query_log(spark, sf_dir)
    return pinned_answers(log, log.where("query_id % 4 = 0").select(F.col("query_id").alias("pin_id"), "user_id", "embedding"))


@query("settled_sites", over_captures("SELECT user_id, site, owner FROM (SELECT user_id, site, arg_max(owner, (ts, owner)) AS owner FROM (SELECT user_id, ts, 'owner' || CAST(capture_id % 4 AS VARCHAR) AS owner, coalesce(nullif(regexp_replace(regexp_extract(lower(url), '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', ''), ''), 'app::' || lower(trim(app))) AS site FROM captures_v) GROUP BY 1, 2) WHERE owner IN ('owner0', 'owner1')"))
def settled_sites_q(spark, sf_dir) -> DataFrame:
    """JN-17: captures stand for the choices of an owner; two of the four owners still exist."""
    log = captures(spark, sf_dir).select("user_id", F.col("ts").alias("at"), F.concat(F.lit("owner"), (F.col("capture_id") % 4).cast("string")).alias("owner"), site_key().alias("site"))
    return settled_sites(log, log.select("owner").where("owner IN ('owner0', 'owner1')"))
