"""Search, ranking and joins over captures, documents and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import over_captures, query
from ..sources.captures import captures, query_log, table
from ..sources.scratch import hashed_among, written
from .filters import CATEGORIES, STOP_WORDS, content_words, question_category
from .sessions import seconds
from .termtiles import bm25_weights, term_search
from .tiles import vector_search

RE_ASK = 0.60
REPHRASE = (15, 180)
RE_ASK_AFTER = 20 * 3600
#: Half-lives in days that a category starts from, and how many observations they count for.
PRIORS = {"name": 4.2, "number": 2.1, "link": 1.4, "date": 2.8, "place": 4.9, "other": 4.9}
PRIOR_WEIGHT = 3.0
#: Term frequency saturation and length weight of the keyword rank.
K1, B = 1.2, 0.75


def ranked(df: DataFrame, by: list, most: int, *order) -> DataFrame:
    """The first rows of each group; Spark cuts each task's rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def nearest_captures(queries: DataFrame, df: DataFrame, most: int) -> DataFrame:
    """TOPK-1: the captures of a user nearest to each of the user's questions, in double precision.

    Vectors that are null or of another length take no part; ties go to the smaller id.
    """
    q = queries.select("query_id", F.col("user_id").alias("owner"), F.col("embedding").alias("v"))
    rows = df.select(F.col("capture_id").alias("key"), F.col("user_id").alias("owner"), F.lit(0).cast("long").alias("t"), F.col("embedding").alias("v"))
    near = vector_search(q, rows, most).select("query_id", F.col("key").alias("capture_id"), "score")
    return ranked(near, ["query_id"], most, F.desc("score"), "capture_id")


_DOT = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
_Q = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("nearest_captures", over_captures(f"SELECT query_id, capture_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, capture_id) AS rank FROM (SELECT query_id, capture_id, round({_DOT.format('q.embedding', 'c.embedding')}, 6) AS score FROM queries_v q JOIN captures_v c USING (user_id))) WHERE rank <= 40"))
def nearest_captures_q(spark, sf_dir) -> DataFrame:
    return nearest_captures(query_log(spark, sf_dir), captures(spark, sf_dir, vectors=True), 40)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """AGG-22: (key, term, tf, dl) of every text; dl is the number of words."""
    words = docs.select(key, content_words(text).alias("w"))
    return words.select(key, F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


@query("term_statistics", f"WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains([{_Q}], x)) AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS term FROM w) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1")
def term_statistics(spark, sf_dir) -> DataFrame:
    """AGG-22: documents and occurrences of each term."""
    return postings(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def keyword_top(docs: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """TOPK-2, TOPK-13: documents ranked by BM25 over the distinct content words of each question.

    Document frequencies are counted for the terms asked for only; a term in over half of the documents weighs 1e-6.
    Words nobody asked for go before anything is shuffled, and questions meet documents in tiles.
    """
    one = F.lit(0).alias("owner")
    asked = written(queries.select("query_id", one, F.explode(F.array_distinct(content_words())).alias("term")), "asked")
    words = docs.select("doc_id", content_words().alias("w"))
    size = written(words.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("avg_dl")).select(one, "n_docs", "avg_dl"), "sizes")
    each = words.select(F.col("doc_id").alias("key"), F.size("w").alias("dl"), F.explode("w").alias("term"))
    counts = hashed_among(each, asked, ["term"]).groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    counts = written(counts.select(one, "key", "term", "tf", "dl"), "counts")
    near = term_search(*bm25_weights(asked, counts, size, K1, B), size, most).withColumnRenamed("key", "doc_id")
    return ranked(near, ["query_id"], most, F.desc("score"), "doc_id")


@query("keyword_top", over_captures(
    "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 5) AS score "
    "FROM asked JOIN p USING (term) JOIN r USING (term) CROSS JOIN z GROUP BY 1, 2)) WHERE rank <= 5",
    f"dw AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains([{_Q}], x)) AS w FROM documents), z AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_dl FROM dw), "
    "p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM dw) GROUP BY 1, 2), r AS (SELECT term, count(*) AS df FROM p GROUP BY 1), "
    f"asked AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains([{_Q}], x)))) AS term FROM queries_v)"
))
def keyword_top_q(spark, sf_dir) -> DataFrame:
    return keyword_top(table(spark, sf_dir, "documents"), query_log(spark, sf_dir), 5)


@query("reinforced", over_captures("SELECT user_id, capture_id, weight, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, capture_id) AS rank FROM (SELECT user_id, capture_id, round(exp(-date_diff('second', ts + INTERVAL 2 DAY, TIMESTAMP '2024-02-05') / 86400.0 / 90), 6) AS weight FROM captures_v WHERE capture_id % 11 = 0)"))
def reinforced(spark, sf_dir) -> DataFrame:
    """TOPK-4: recalled captures by how often and how lately they were recalled (the recall log holds one recall each here)."""
    log = captures(spark, sf_dir).where("capture_id % 11 = 0").select("user_id", "capture_id", F.expr("ts + INTERVAL 2 DAY").alias("recalled_at"))
    log = log.groupBy("user_id", "capture_id").agg(F.count("*").alias("n"), F.max("recalled_at").alias("recalled_at"))
    days = F.expr("(unix_timestamp(timestamp'2024-02-05') - unix_timestamp(cast(recalled_at AS timestamp))) / 86400D")
    log = log.select("user_id", "capture_id", F.round(F.col("n") * F.exp(-days / 90), 6).alias("weight"))
    return log.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("weight"), "capture_id")))


def forgetting_events(log: DataFrame) -> DataFrame:
    """JN-4: for each question the earliest like one of the user that was asked shortly before, or long before.

    Gaps of neither kind are passed over.  Each user's questions are compared in tiles, of which the earliest of each question leaves.
    """
    now = F.unix_seconds(F.col("ts").cast("timestamp"))
    q = log.select("query_id", F.col("user_id").alias("owner"), now.alias("now"), F.col("embedding").alias("v"))
    rows = log.select(F.col("query_id").alias("key"), F.col("user_id").alias("owner"), now.alias("t"), F.col("embedding").alias("v"))
    spans = [(F.col("now") - REPHRASE[1], F.col("now") - REPHRASE[0]), (None, F.col("now") - RE_ASK_AFTER)]
    found = vector_search(q, rows, 1, spans=spans, least=RE_ASK, earlier=True, by_key=True)
    old = log.select(F.col("query_id").alias("prior_id"), F.col("ts").alias("prior_ts"))
    pairs = found.select("query_id", F.col("key").alias("prior_id")).join(old.hint("merge"), "prior_id").join(log.hint("merge"), "query_id")
    first = pairs.select("query_id", "user_id", "text", F.struct("prior_id", seconds("prior_ts", "ts").alias("gap")).alias("x"))
    kind = F.when(F.col("x.gap") >= RE_ASK_AFTER, "re-ask").otherwise("rephrase")
    return first.select("query_id", "user_id", "x.prior_id", kind.alias("kind"), question_category().alias("category"), F.when(kind == "re-ask", F.round(F.col("x.gap") / 86400, 2)).otherwise(0.0).alias("gap_days"))


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(q.text), '{p}') THEN '{n}'" for n, p in CATEGORIES) + " ELSE 'other' END"
_EVENTS = (
    f"ev0 AS (SELECT q.query_id, q.user_id, p.query_id AS prior_id, {_CATEGORY} AS category, date_diff('second', p.ts, q.ts) AS gap, row_number() OVER (PARTITION BY q.query_id ORDER BY p.query_id) AS r FROM queries_v q JOIN queries_v p ON p.user_id = q.user_id AND p.query_id < q.query_id "
    f"WHERE {_DOT.format('q.embedding', 'p.embedding')} >= 0.60 AND (date_diff('second', p.ts, q.ts) BETWEEN 15 AND 180 OR date_diff('second', p.ts, q.ts) >= 72000)), "
    "ev AS (SELECT query_id, user_id, prior_id, CASE WHEN gap >= 72000 THEN 're-ask' ELSE 'rephrase' END AS kind, category, CASE WHEN gap >= 72000 THEN round(gap / 86400.0, 2) ELSE 0.0 END AS gap_days FROM ev0 WHERE r = 1)"
)


@query("forgetting_events", over_captures("SELECT * FROM ev", _EVENTS))
def forgetting_events_q(spark, sf_dir) -> DataFrame:
    return forgetting_events(query_log(spark, sf_dir))


_PRIORS = "pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in PRIORS.items()) + ") v(category, prior))"


@query("forgetting_signature", over_captures(
    "SELECT category, round((prior * 3 + coalesce(g, 0)) / (3 + coalesce(n, 0)), 1) AS half_life, round(CASE WHEN coalesce(n, 0) < 5 THEN -0.5 ELSE greatest(-0.8, least(-0.2, -0.5 / greatest(cv, 0.05))) END, 2) AS decay, coalesce(events, 0) AS events, coalesce(n, 0) AS observed FROM pr LEFT JOIN "
    "(SELECT category, count(*) AS events, count(*) FILTER (WHERE gap_days > 0) AS n, sum(gap_days) FILTER (WHERE gap_days > 0) AS g, stddev_pop(gap_days) FILTER (WHERE gap_days > 0) / avg(gap_days) FILTER (WHERE gap_days > 0) AS cv FROM ev GROUP BY 1) USING (category)", _EVENTS + ", " + _PRIORS))
def forgetting_signature(spark, sf_dir) -> DataFrame:
    """AGG-12: half-life and decay of each category, from the gaps of questions asked again and a prior; all categories are there."""
    gap = F.when(F.col("gap_days") > 0, F.col("gap_days"))
    seen = forgetting_events(query_log(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("events"), F.count(gap).alias("n"), F.sum(gap).alias("g"), (F.stddev_pop(gap) / F.avg(gap)).alias("cv"))
    every = spark.createDataFrame(list(PRIORS.items()), "category string, prior double")
    n, g = F.coalesce("n", F.lit(0)), F.coalesce("g", F.lit(0.0))
    decay = F.when(n < 5, -0.5).otherwise(F.greatest(F.lit(-0.8), F.least(F.lit(-0.2), -0.5 / F.greatest("cv", F.lit(0.05)))))
    return every.join(seen, "category", "left").select("category", F.round((F.col("prior") * PRIOR_WEIGHT + g) / (PRIOR_WEIGHT + n), 1).alias("half_life"), F.round(decay, 2).alias("decay"), F.coalesce("events", F.lit(0)).alias("events"), n.alias("observed"))


def prior_versions(df: DataFrame) -> DataFrame:
    """JN-1: (capture_id, prior_id): the version of a page to compare a capture with: the newest five minutes older, else the one before; null for the first."""
    df = df.withColumn("at", F.expr("unix_timestamp(cast(ts AS timestamp))"))
    page = Window.partitionBy("user_id", "page_key")
    old = F.max(F.struct("ts", "capture_id")).over(page.orderBy("at").rangeBetween(Window.unboundedPreceding, -300))
    return df.select("capture_id", F.coalesce(old["capture_id"], F.lag("capture_id").over(page.orderBy("ts", "capture_id"))).alias("prior_id"))


@query("page_versions", over_captures(
    "SELECT k.capture_id, coalesce((SELECT arg_max(o.capture_id, (o.ts, o.capture_id)) FROM keyed o WHERE o.user_id = k.user_id AND o.page_key = k.page_key AND date_diff('second', o.ts, k.ts) >= 300), "
    "(SELECT arg_max(o.capture_id, (o.ts, o.capture_id)) FROM keyed o WHERE o.user_id = k.user_id AND o.page_key = k.page_key AND (o.ts, o.capture_id) < (k.ts, k.capture_id))) AS prior_id FROM keyed k"
))
def page_versions(spark, sf_dir) -> DataFrame:
    return prior_versions(captures(spark, sf_dir, keyed=True))


@query("question_window", over_captures("SELECT q.query_id, count(*) AS n, max(c.capture_id) AS last_id FROM queries_v q JOIN captures_v c ON c.user_id = q.user_id AND c.ts BETWEEN q.ts - INTERVAL 3 DAY AND q.ts GROUP BY 1"))
def question_window(spark, sf_dir) -> DataFrame:
    """JN-12: captures in the three days before each question; both sides are dealt by user and day, so no pair outside is made."""
    day = lambda c: F.unix_date(F.to_date(c))
    q = query_log(spark, sf_dir).select("query_id", "user_id", F.col("ts").alias("until")).withColumn("since", F.expr("until - INTERVAL 3 DAY"))
    q = q.withColumn("bucket", F.explode(F.sequence(day("since"), day("until"))))
    c = captures(spark, sf_dir).select("user_id", "capture_id", "ts", day("ts").alias("bucket"))
    return c.join(q.hint("merge"), ["user_id", "bucket"]).where("ts BETWEEN since AND until").groupBy("query_id").agg(F.count("*").alias("n"), F.max("capture_id").alias("last_id"))


@query("known_apps", over_captures("SELECT user_id, app, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, app) AS rank FROM (SELECT user_id, app, count(*) AS n FROM captures_v GROUP BY 1, 2 HAVING count(*) >= 5)) WHERE rank <= 40"))
def known_apps(spark, sf_dir) -> DataFrame:
    """JN-13: the vocabulary of apps a question of a user may name."""
    n = captures(spark, sf_dir).groupBy("user_id", "app").agg(F.count("*").alias("n")).where("n >= 5")
    return ranked(n, ["user_id"], 40, F.desc("n"), "app")


@query("topic_digest", over_captures(
    "SELECT user_id, day, page_key, visits, first_ts, last_ts, coalesce(n_lines, 0) AS n_lines FROM (SELECT user_id, day, page_key, count(*) AS visits, min(ts) AS first_ts, max(ts) AS last_ts FROM kd GROUP BY 1, 2, 3) LEFT JOIN "
    "(SELECT user_id, day, page_key, count(*) AS n_lines FROM (SELECT user_id, day, k, arg_min(page_key, (ts, capture_id, page_key)) AS page_key FROM ln WHERE length(k) >= 4 GROUP BY 1, 2, 3) GROUP BY 1, 2, 3) USING (user_id, day, page_key)",
    "kd AS (SELECT *, CAST(ts AS DATE) AS day FROM keyed), ln AS (SELECT user_id, day, page_key, ts, capture_id, lower(trim(unnest(string_split(ocr_text, chr(10))))) AS k FROM kd)"
))
def topic_digest(spark, sf_dir) -> DataFrame:
    """AGG-14: the topics of a user's day, each with the lines seen there first; a line counts once a day."""
    # a document's lines are told by hashes, once; a user's day lies in one task before they are spread out
    lines = F.transform(F.filter(F.transform(F.split("ocr_text", "\n"), lambda x: F.lower(F.trim(x))), lambda k: F.length(k) >= 4), lambda k: F.unhex(F.md5(k)))
    df = captures(spark, sf_dir, keyed=True, made={"ks": F.array_distinct(lines)}).withColumn("day", F.to_date("ts"))
    spread = df.select("user_id", "day", "page_key", "ts", "capture_id", "ks").repartition("user_id", "day").select("user_id", "day", "page_key", "ts", "capture_id", F.explode("ks").alias("k"))
    first = spread.groupBy("user_id", "day", "k").agg(F.min(F.struct("ts", "capture_id", "page_key")).alias("x"))
    n = first.groupBy("user_id", "day", "x.page_key").agg(F.count("*").alias("n_lines"))
    topics = df.groupBy("user_id", "day", "page_key").agg(F.count("*").alias("visits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return topics.join(n.hint("merge"), ["user_id", "day", "page_key"], "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


@query("latest_value", "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_value(spark, sf_dir) -> DataFrame:
    """SNK-3, STR-11: one row for each natural key, the last write wins; one aggregate, no sort."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("x"))
    return e.select("user_id", "event_type", "x.value", "x.event_id")


@query("without_forgotten", over_captures("SELECT capture_id FROM captures_v WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id AS u, max(ts) AS last FROM captures_v GROUP BY 1) WHERE u = user_id AND ts >= last - INTERVAL 10 MINUTE)"))
def without_forgotten(spark, sf_dir) -> DataFrame:
    """STR-8: what stays when each user forgets the last ten minutes."""
    df = captures(spark, sf_dir)
    last = df.groupBy("user_id").agg(F.max("ts").alias("last"))
    return df.join(last, "user_id").where("ts < last - INTERVAL 10 MINUTE").select("capture_id")
