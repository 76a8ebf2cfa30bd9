"""Text jobs over documents, pages, conversations and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import recall_probability
from ..plans.catalog import over_captures, query
from ..sources.captures import captures, query_log, table
from ..sources.scratch import BROADCAST_ROWS, written

_Q = lambda words: ", ".join(f"'{w}'" for w in words)
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
_WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\r\n\f]+'), lambda x: x <> '')"
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query("credential_screen", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in T.CREDENTIALS) + " END AS label FROM documents")
def credential_screen(spark, sf_dir) -> DataFrame:
    """TXT-2."""
    return table(spark, sf_dir, "documents").select("doc_id", T.credential().alias("label"))


@query("redacted")
def redacted(spark, sf_dir) -> DataFrame:
    """TXT-1, FLT-8: masked first, then cut to 25,000 characters, so that a number at the cut is masked too."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(T.redact(), 1, 25_000).alias("text"))


@query("doubled_collapsed")
def doubled_collapsed(spark, sf_dir) -> DataFrame:
    """TXT-3."""
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_doubled().alias("text"))


@query("doubled_words", f"WITH {_LINES}, t AS (SELECT doc_id, {_WORDS.format('line')} AS w FROM l) SELECT doc_id, sum(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])))::BIGINT AS doubled FROM t GROUP BY 1")
def doubled_words(spark, sf_dir) -> DataFrame:
    """TXT-4."""
    return table(spark, sf_dir, "documents").select("doc_id", T.doubled_words().alias("doubled"))


@query("turn_overlap", "WITH c AS (SELECT conv_id, turn, list_distinct(" + _WORDS.format("lower(text)") + ") AS a, list_distinct(" + _WORDS.format("lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn))") + ") AS b FROM conversations) "
    "SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS overlap FROM c WHERE b IS NOT NULL")
def turn_overlap(spark, sf_dir) -> DataFrame:
    """TXT-5: each turn against the one before it."""
    c = table(spark, sf_dir, "conversations").withColumn("last", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where("last IS NOT NULL").select("conv_id", "turn", F.round(T.overlap("text", "last"), 6).alias("overlap"))


_CHURN = " OR ".join(f"regexp_matches(line, '(?i){p}')" for p in T.CHURN)
_CLEAN = rf"""{_LINES}, s AS (SELECT doc_id, trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g')) AS line FROM l),
 k AS (SELECT * FROM s WHERE length(line) >= 3 AND NOT ({_CHURN}) AND len(list_filter(regexp_extract_all(lower(line), '[a-z]+'), lambda w: list_contains([{_Q(T.CHROME_WORDS)}], w))) < 3)"""


@query("clean_lines", f"WITH {_CLEAN} SELECT d.doc_id, count(k.line) AS n_lines, coalesce(sum(length(k.line)), 0)::BIGINT AS n_chars FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1")
def clean_lines(spark, sf_dir) -> DataFrame:
    """TXT-6."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.clean_lines().alias("lines"))
    return d.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.length(F.array_join("lines", "")).cast("long").alias("n_chars"))


@query("snippets", r"SELECT doc_id, trim(left(regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')), '" + T.MENU_BAR + "', ''), '" + T.JUNK_HEAD + "', ''), 120)) AS snippet FROM documents")
def snippets(spark, sf_dir) -> DataFrame:
    """TXT-7."""
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet().alias("snippet"))


@query("page_links", f"WITH x AS (SELECT page_id, regexp_extract_all(html, '{T.LINK}') AS u, regexp_extract_all(html, '{T.NUMBER}') AS n FROM pages) SELECT page_id, array_to_string(({_FIRST.format('u')})[1:8], '|') AS links, array_to_string(({_FIRST.format('n')})[1:12], '|') AS numbers FROM x")
def page_links(spark, sf_dir) -> DataFrame:
    """TXT-9: the first distinct links and numbers of a page."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.first_found("html", T.LINK, 8), "|").alias("links"), F.array_join(T.first_found("html", T.NUMBER, 12), "|").alias("numbers"))


@query("message_body", f"SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (regexp_matches(x, '{T.QUOTE}') OR regexp_matches(x, '{T.SIGNATURE}') OR regexp_matches(x, '{T.DISCLAIMER}'))), chr(10)) AS body FROM conversations")
def message_body(spark, sf_dir) -> DataFrame:
    """TXT-10."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.body().alias("body"))


@query("sentences", f"WITH s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '{T.SENTENCE_END}'), lambda s: trim(s)), lambda s: length(s) BETWEEN 8 AND 200 AND len(regexp_extract_all(s, '[A-Za-z]{{2,}}')) >= 3) AS s FROM conversations) SELECT conv_id, turn, len(s)::BIGINT AS n, array_to_string(s, '|') AS sentences FROM s")
def sentences(spark, sf_dir) -> DataFrame:
    """TXT-11."""
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sentences().alias("s"))
    return s.select("conv_id", "turn", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("sentences"))


_STEM = "list_transform(list_filter(regexp_extract_all(regexp_replace(lower(text), '[*_`]+', '', 'g'), '[a-z0-9]{3,}'), lambda w: NOT list_contains([" + _Q(T.THREAD_STOP_WORDS) + "], w)), lambda w: CASE WHEN starts_with(w, 'un') AND length(w) >= 6 THEN w[3:] ELSE w END)"
_STEM = f"list_transform({_STEM}, lambda w: CASE WHEN regexp_matches(w, '^.{{4,}}ing$') THEN left(w, length(w) - 3) WHEN regexp_matches(w, '^.{{4,}}(ed|es)$') THEN left(w, length(w) - 2) WHEN regexp_matches(w, '^.{{4,}}s$') AND NOT regexp_matches(w, 'ss$') THEN left(w, length(w) - 1) ELSE w END)"


@query("thread_keys", f"SELECT conv_id, turn, left(array_to_string(list_sort(list_distinct({_STEM})), ' '), 200) AS thread_key FROM conversations")
def thread_keys(spark, sf_dir) -> DataFrame:
    """TXT-19."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(F.array_join(T.content_stems(), " "), 1, 200).alias("thread_key"))


@query("day_phrases", over_captures("SELECT capture_id, CASE WHEN d <= 0 THEN 'earlier today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN 'on ' || strftime(ts, '%A') ELSE 'on ' || strftime(ts, '%b %-d') END AS phrase FROM (SELECT *, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS d FROM captures_v)"))
def day_phrases(spark, sf_dir) -> DataFrame:
    """TXT-20."""
    return captures(spark, sf_dir).select("capture_id", T.day_phrase("ts", "2024-01-31").alias("phrase"))


_TRI = "list_transform(regexp_extract_all(lower(text), '[a-z0-9]{3,}')[1:12], lambda w: list_transform(range(1, length(w) - 1), lambda i: w[i:i + 2]))"


@query("query_trigrams", over_captures(f"SELECT query_id, array_to_string({_FIRST.format('t')}, ' ') AS trigrams FROM (SELECT query_id, flatten({_TRI}) AS t FROM queries_v)"))
def query_trigrams(spark, sf_dir) -> DataFrame:
    """TXT-23."""
    return query_log(spark, sf_dir).select("query_id", F.array_join(T.trigrams(), " ").alias("trigrams"))


@query("document_owner", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(source) END AS owner FROM documents")
def document_owner(spark, sf_dir) -> DataFrame:
    """TXT-27: even documents lie in their source's folder, odd ones at the top level."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("/"), name)).otherwise(name)
    return table(spark, sf_dir, "documents").withColumn("path", path).select("doc_id", T.owner().alias("owner"))


@query("recall_curve", over_captures("SELECT capture_id, round(power(1 + (power(0.5, 1 / -0.5) - 1) * (date_diff('second', ts, TIMESTAMP '2024-01-31') / 86400.0 / 4.9), -0.5), 6) AS recall FROM captures_v"))
def recall_curve(spark, sf_dir) -> DataFrame:
    """TXT-29: how likely a capture is still remembered, with a half-life of 4.9 days."""
    days = F.expr("(unix_timestamp(timestamp'2024-01-31') - unix_timestamp(cast(ts AS timestamp))) / 86400D")
    return captures(spark, sf_dir).select("capture_id", F.round(recall_probability(days, F.lit(4.9), F.lit(-0.5)), 6).alias("recall"))


@query("without_repeated_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
 n AS (SELECT *, regexp_replace(trim(regexp_replace(lower(line), '[^a-z0-9 ]', '', 'g')), ' +', ' ', 'g') AS k FROM l),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS r FROM n) SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM r WHERE length(k) < 12 OR r = 1 GROUP BY 1""")
def without_repeated_lines(spark, sf_dir) -> DataFrame:
    """TXT-33: of lines that agree but for case and marks the first stays; short lines all stay; order is kept."""
    return distinct_lines(table(spark, sf_dir, "documents"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a text's lines are told apart inside its row; rows of one id count as one text, and their lines meet in a shuffle."""
    key = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9 ]", "")), " +", " ")
    lines = F.transform(T.lines_of("text"), lambda x, i: F.struct(key(x).alias("k"), i.alias("pos"), x.alias("line")))
    rows = docs.where("text IS NOT NULL").select("doc_id", F.array_sort(lines).alias("x"))
    again = written(docs.where("text IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    many = again.select(F.col("doc_id").alias("again")).hint("broadcast" if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else "merge")
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    one = rows.join(many, same, "left_anti")
    more = rows.join(many, same, "left_semi").groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("x"))).alias("x"))
    # sorted by key and place: a long line stays where the one before it has another key
    first = F.expr("filter(x, (l, i) -> length(l.k) < 12 OR i = 0 OR x[i - 1].k <> l.k)")
    kept = F.array_sort(F.transform(first, lambda l: F.struct(l.pos.alias("pos"), l.line.alias("line"))))  # noqa: E741
    return one.unionByName(more).select("doc_id", F.array_join(F.transform(kept, lambda l: l.line), "\n").alias("text"))  # noqa: E741


@query("screen_triggers", over_captures(f"SELECT capture_id, regexp_matches(ocr_text, '{T.STACK_TRACE}') AS stack_trace, regexp_matches(ocr_text, '{T.MEETING}') AS meeting FROM captures_v"))
def screen_triggers(spark, sf_dir) -> DataFrame:
    """TXT-34, over whole texts."""
    text = F.col("ocr_text")
    return captures(spark, sf_dir, made={"stack_trace": text.rlike(T.STACK_TRACE), "meeting": text.rlike(T.MEETING)}).select("capture_id", "stack_trace", "meeting")
