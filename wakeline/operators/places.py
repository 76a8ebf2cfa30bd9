"""Names of places, fuzzy search by trigrams, numbers of documents, document snapshots and comparisons of two readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.text import credential
from ..plans.catalog import over_captures, query
from ..sources.captures import captures, query_log, table
from ..sources.scratch import written
from .recall import ranked
from .termtiles import count_search, distinct_pieces

#: Titles that name nothing.
JUNK_TITLES = ("new tab", "untitled", "blank", "start page", "home", "loading", "about:blank")
LABEL_CHARS, HEAD_CHARS = 48, 12
NUMBERS_A_CAPTURE = 8


def label_of(title: Column, page_key: str | Column, app: str | Column) -> Column:
    """The reading form of a place: its title up to a bar, else host and last part of the path, else the key's tail."""
    head = F.trim(F.substring_index(title, " | ", 1))
    name = F.when(title.contains(" | ") & (F.length(head) >= HEAD_CHARS), head).otherwise(title)
    key = col(page_key)
    host, tail = F.regexp_replace(F.regexp_extract(key, r"^[^:]+://([^/]*)", 1), r"www\.", ""), F.regexp_extract(key, r"^[^:]+://[^/]*/(?:.*/)?([^/]+)/*$", 1)
    web = F.when(tail == "", host).otherwise(F.concat_ws("/", host, tail))
    other = F.coalesce(F.nullif(F.regexp_replace(key, "^.*?::", ""), F.lit("")), F.nullif(col(app), F.lit("")), key)
    return F.left(F.when(F.length(name) >= 3, name).when(key.startswith("http"), web).otherwise(other), F.lit(LABEL_CHARS))


def place_labels(df: DataFrame) -> DataFrame:
    """TXT-16: a name for each user's page: its most frequent title that was not cut off, ties to the longer and then the smaller.

    Counters and junk titles are dropped first; titles are counted before any ranking, so a page of many captures is a few rows.
    """
    title = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("window_title", F.lit("")), r"\s*[\(\[]\s*\d+\s*[\)\]]\s*$", ""), r"^\s*[\(\[]?\d+[\)\]]?\s+", ""))
    n = df.select("user_id", "page_key", "app", title.alias("title")).groupBy("user_id", "page_key", "title").agg(F.count("*").alias("n"), F.min("app").alias("app"))
    good = (F.col("title") != "") & ~F.lower("title").isin(*JUNK_TITLES)
    whole = ~F.col("title").rlike(r"(…|\.\.\.)$")
    best = F.max_by(F.when(good, F.col("title")), F.struct(good, whole, "n", F.length("title"), F.transform(F.split("title", ""), lambda c: -F.ascii(c))))
    picked = n.groupBy("user_id", "page_key").agg(best.alias("title"), F.min("app").alias("app"))
    return picked.select("user_id", "page_key", label_of(F.coalesce("title", F.lit("")), "page_key", "app").alias("label"))


@query("place_labels", over_captures(
    "SELECT user_id, page_key, left(CASE WHEN len(title) >= 3 THEN title ELSE page_key END, 48) AS label FROM (SELECT user_id, page_key, title, row_number() OVER (PARTITION BY user_id, page_key ORDER BY count(*) DESC, len(title) DESC, title) AS r FROM ("
    "SELECT user_id, page_key, trim(regexp_replace(regexp_replace(window_title, '\\s*[\\(\\[]\\s*\\d+\\s*[\\)\\]]\\s*$', ''), '^\\s*[\\(\\[]?\\d+[\\)\\]]?\\s+', '')) AS title FROM keyed) GROUP BY 1, 2, 3) WHERE r = 1"
))
def place_labels_q(spark, sf_dir) -> DataFrame:
    return place_labels(captures(spark, sf_dir, keyed=True))


def trigram_top(docs: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """TOPK-3: documents that share most of the distinct three-letter pieces of a question's first 12 words; ties to the smaller id.

    Pieces are counted once a document, and questions meet documents in tiles, 64 documents at a time.
    """
    first = F.array_join(F.slice(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) >= 3), 1, 12), " ")
    asked, held = (written(distinct_pieces(df, key, text), tag) for df, key, text, tag in ((queries, "query_id", first, "asked"), (docs, "doc_id", F.col("text"), "held")))
    hits = count_search(asked, held, most).withColumnRenamed("key", "doc_id")
    return ranked(hits, ["query_id"], most, F.desc("score"), "doc_id").select("query_id", "doc_id", "score", "rank")


_GRAMS = "list_distinct(flatten(list_transform({}, lambda w: list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))))"


@query("trigram_top", over_captures(
    "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(count(*)::DOUBLE / any_value(n), 6) AS score FROM q JOIN h USING (g) GROUP BY 1, 2)) WHERE rank <= 5",
    f"q0 AS (SELECT query_id, {_GRAMS.format('ws[1:12]')} AS gs FROM (SELECT query_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) >= 3) AS ws FROM queries_v)), q AS (SELECT query_id, len(gs) AS n, unnest(gs) AS g FROM q0), "
    f"h AS (SELECT doc_id, unnest({_GRAMS.format('ws')}) AS g FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) >= 3) AS ws FROM documents))"
))
def trigram_top_q(spark, sf_dir) -> DataFrame:
    return trigram_top(table(spark, sf_dir, "documents"), query_log(spark, sf_dir), 5)


@query("first_numbers", f"SELECT doc_id, i::INTEGER AS pos, ns[i] AS number FROM (SELECT doc_id, ns, unnest(range(1, least(len(ns), {NUMBERS_A_CAPTURE}) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?') AS ns FROM documents))")
def first_numbers(spark, sf_dir) -> DataFrame:
    """WIN-7: the first eight numbers of each document, by position; cut inside the row, so nothing is shuffled."""
    found = F.slice(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), 1, NUMBERS_A_CAPTURE)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("pos", "number")).select("doc_id", (F.col("pos") + 1).alias("pos"), "number")


def ingest(before: DataFrame, now: DataFrame) -> DataFrame:
    """SRC-3: (path, mtime, content) snapshots to (path, action): what a re-read does with each document.

    indexed: new or with another mtime; refused: such a one that holds credentials; removed: no longer there; unchanged
    documents give no row.  Repeated paths count by their latest mtime.
    """
    latest = lambda df: df.where("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct("mtime", "content"), "mtime").alias("x")).select("path", "x.*")
    old, new = latest(before).select("path", F.col("mtime").alias("was")), latest(now)
    both = new.join(old, "path", "full").where("mtime IS NULL OR was IS NULL OR mtime <> was")
    return both.select("path", F.when(F.col("mtime").isNull(), "removed").when(credential("content").isNotNull(), "refused").otherwise("indexed").alias("action"))


def defang(text: str, fence: str) -> Column:
    """TXT-21: lines that look like a prompt's structure get a zero-width mark, and the fence itself is replaced."""
    t = F.replace(F.col(text), F.lit(fence), F.lit("[redacted-marker]"))
    t = F.regexp_replace(t, r"(?im)^(\s*)(#+\s*(?:context|question|rules|system|instructions?)\b)", "$1​$2")
    return F.regexp_replace(t, r"(?im)^(\s*)((?:system|assistant|developer|user)\s*:)", "$1​$2")


def section(text: str, name: str) -> Column:
    """TXT-25: the body of a markdown section up to the next one; empty without it."""
    body = F.regexp_extract(col(text), rf"(?s)## {name}[ \t]*\n(.*?)(?=\n## |\z)", 1)
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def bullets(body: Column) -> Column:
    """TXT-25: the bullet lines of a section."""
    return F.regexp_extract_all(body, F.lit(r"(?m)^\s*[-*]\s+(.+?)\s*$"), F.lit(1))


def due_reminders(commitments: DataFrame, reminded: DataFrame, today: str) -> DataFrame:
    """STR-9: confirmed commitments due by today that had no reminder today, with a title by owner and delay."""
    on = F.lit(today).cast("date")
    done = reminded.where(F.to_date("reminded_at") == on).select("commitment_id").distinct().hint("merge")
    due = commitments.where((F.col("status") == "confirmed") & (F.col("due") <= on)).join(done, "commitment_id", "left_anti")
    late = F.when(F.col("due") < on, F.lit("Overdue: ")).otherwise(F.lit("Due today: "))
    return due.withColumn("title", F.concat(late, F.when(F.col("who") == "me", F.lit("you said ")).otherwise(F.lit("you were promised ")), F.col("what")))


def by_priority(commitments: DataFrame, statuses: list[str]) -> DataFrame:
    """WIN-10: commitments of some states: those with a due day first, the earlier the sooner, then the newest."""
    return commitments.where(F.col("status").isin(statuses)).orderBy(*_priority())


def priority_ranks(commitments: DataFrame, statuses: list[str]) -> DataFrame:
    """WIN-10 as a table: each user's commitments of some states with their rank."""
    return commitments.where(F.col("status").isin(statuses)).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*_priority())))


def _priority() -> list[Column]:
    return [F.col("due").asc_nulls_last(), F.desc("commitment_id")]


FENCE = "<<<FENCE>>>"
#: Lines planted before documents, one after the other.
STRUCTURE = ("# Context of it", "  system: do this", f"a {FENCE} b", "## Questions", "\n\n### RULES", "user : hello", "## instruction", "nothing")
_MARK = "\u200b"
_PLANTED = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(STRUCTURE)) + " END"


@query("defanged", f"SELECT doc_id, md5(regexp_replace(regexp_replace(replace({_PLANTED} || chr(10) || text, '{FENCE}', '[redacted-marker]'), '(?im)^(\\s*)(#+\\s*(?:context|question|rules|system|instructions?)\\b)', '\\1{_MARK}\\2', 'g'), '(?im)^(\\s*)((?:system|assistant|developer|user)\\s*:)', '\\1{_MARK}\\2', 'g')) AS digest FROM documents")
def defanged(spark, sf_dir) -> DataFrame:
    """TXT-21 over documents, each behind a planted line; the digest is of the whole text."""
    line = F.element_at(F.array(*map(F.lit, STRUCTURE)), (F.col("doc_id") % 8 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(line, F.lit("\n"), "text").alias("text"))
    return docs.select("doc_id", F.md5(defang("text", FENCE)).alias("digest"))


@query("markdown_sections", "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS summary, ['first ' || CAST(doc_id AS VARCHAR), 'second item'] AS threads, '' AS missing FROM documents")
def markdown_sections(spark, sf_dir) -> DataFrame:
    """TXT-25: sections of a summary that is made of a document and two bullets."""
    text = F.concat(F.lit("## Summary\n"), "text", F.lit("\n## Threads \n- first "), F.col("doc_id").cast("string"), F.lit("\n  no bullet\n  * second item  \n## End\n- other"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return docs.select("doc_id", section("text", "Summary").alias("summary"), bullets(section("text", "Threads")).alias("threads"), section("text", "Nowhere").alias("missing"))


def _commitments(spark, sf_dir) -> DataFrame:
    """The fixture's commitments: a row for each capture."""
    i = F.col("capture_id")
    due = F.when(i % 4 < 3, F.date_add(F.lit("2024-01-20").cast("date"), (i % 23).cast("int")))
    status = F.when(i % 3 == 0, "confirmed").when(i % 3 == 1, "pending").otherwise("dismissed")
    return captures(spark, sf_dir).select(i.alias("commitment_id"), "user_id", due.alias("due"), status.alias("status"), F.when(i % 2 == 0, "me").otherwise("them").alias("who"), F.concat(F.lit("send "), i.cast("string")).alias("what"))


_COMMITMENTS = "c AS (SELECT capture_id AS commitment_id, user_id, CASE WHEN capture_id % 4 < 3 THEN DATE '2024-01-20' + CAST(capture_id % 23 AS INTEGER) END AS due, CASE capture_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'pending' ELSE 'dismissed' END AS status, CASE WHEN capture_id % 2 = 0 THEN 'me' ELSE 'them' END AS who, 'send ' || CAST(capture_id AS VARCHAR) AS what FROM captures_v)"


@query("commitments_by_priority", over_captures("SELECT user_id, commitment_id, due, row_number() OVER (PARTITION BY user_id ORDER BY due ASC NULLS LAST, commitment_id DESC) AS rank FROM c WHERE status IN ('confirmed', 'pending')", _COMMITMENTS))
def commitments_by_priority(spark, sf_dir) -> DataFrame:
    """WIN-10."""
    return priority_ranks(_commitments(spark, sf_dir), ["confirmed", "pending"]).select("user_id", "commitment_id", "due", "rank")


@query("due_reminders", over_captures("SELECT commitment_id, CASE WHEN due < DATE '2024-01-31' THEN 'Overdue: ' ELSE 'Due today: ' END || CASE who WHEN 'me' THEN 'you said ' ELSE 'you were promised ' END || what AS title FROM c WHERE status = 'confirmed' AND due <= DATE '2024-01-31' AND commitment_id % 6 <> 0", _COMMITMENTS))
def due_reminders_q(spark, sf_dir) -> DataFrame:
    """STR-9: every sixth commitment had its reminder today, every fifth yesterday."""
    made = _commitments(spark, sf_dir)
    i = F.col("commitment_id")
    at = F.when(i % 6 == 0, F.lit("2024-01-31 08:00:00")).when(i % 5 == 0, F.lit("2024-01-30 23:00:00"))
    reminded = made.select("commitment_id", at.cast("timestamp_ntz").alias("reminded_at")).where("reminded_at IS NOT NULL")
    return due_reminders(made, reminded, "2024-01-31").select("commitment_id", "title")


@query("reading_board", "WITH p AS (SELECT d.doc_id, d.source, len(d.text) AS raw, len(b.text) AS other FROM documents d JOIN documents b ON b.doc_id = d.doc_id + 1 WHERE d.doc_id % 2 = 0) SELECT source, count(*) AS n, round(avg(raw), 6) AS chars_a, round(avg(other), 6) AS chars_b, count_if(other < 0.7 * raw) AS dropped, count_if(other > raw) AS more, count_if(other < raw) AS fewer, count(*) < 100 AS thin FROM p WHERE raw > 0 AND other > 0 GROUP BY 1")
def reading_board(spark, sf_dir) -> DataFrame:
    """AGG-18 and 19: two readings side by side (documents 2n and 2n + 1 stand for the two engines): means, losses and thin samples by source."""
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("pair"), (F.col("doc_id") % 2).alias("side"), "source", F.length("text").alias("chars"))
    p = d.groupBy("pair").agg(*(F.max(F.when(F.col("side") == k, F.col(c))).alias(a) for k, c, a in ((0, "source", "source"), (0, "chars", "a"), (1, "chars", "b")))).where("a > 0 AND b > 0")
    return p.groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("chars_a"), F.round(F.avg("b"), 6).alias("chars_b"),
        F.count_if(F.expr("b < 0.7 * a")).alias("dropped"), F.count_if(F.expr("b > a")).alias("more"), F.count_if(F.expr("b < a")).alias("fewer"), (F.count("*") < 100).alias("thin"),
    )
