"""Open threads over nightly summaries, salient lines, and the identity that a document belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.text import clean_lines, content_stems
from ..plans.catalog import query
from ..sources.captures import table
from .text import _STEM

MIN_SHARED, SAME_THREAD, LOOKBACK, MOST_THREADS = 2, 0.5, 30, 8
LINE_CHARS, KEY_CHARS, SALIENT = (15, 160), 50, 6
#: What an address or a phrase says of the identity that a document belongs to.
ADDRESS = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+"
SCHOOL, PERSONAL = r"\.edu\b", r"@(gmail|yahoo|outlook|hotmail|icloud|proton(mail)?)\."
VOTES = {"school": r"\b(university|campus|student\s*id|transcript|canvas)\b", "work": r"\b(invoice|contract|freelance|llc|consulting)\b"}
SHARED_DOCUMENT = r"\b(resume|cv|curriculum[ _-]?vitae|transcript|portfolio|links|diploma|certificate|references?|cover[ _-]?letter)\b"


def same_thread(a: str, b: str) -> Column:
    """JN-8: whether two arrays of content stems share two words or more, and half of the smaller one."""
    shared = F.size(F.array_intersect(a, b))
    return (shared >= MIN_SHARED) & (shared >= SAME_THREAD * F.least(F.size(a), F.size(b)))


def open_threads(threads: DataFrame, dismissed: DataFrame | None = None, most: int = MOST_THREADS) -> DataFrame:
    """WIN-5: (user_id, day, text), a row for each line of a nightly summary, to the latest night's threads with their age.

    A thread's nights are those before the latest, one after the other, that hold a thread like it; the first night without
    one ends them.  Threads like one in dismissed (user_id, text) are left out (JN-9).  The longest open come first, ties by
    text; repeated lines count once; a user looks LOOKBACK nights back, so a current thread meets a bounded history.
    """
    t = threads.where("text IS NOT NULL AND day IS NOT NULL").select("user_id", "day", "text").distinct().withColumn("words", content_stems("text"))
    t = t.withColumn("night", F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).where(F.col("night") <= LOOKBACK)
    now = t.where("night = 1").select("user_id", F.col("day").alias("latest"), "text", "words")
    if dismissed is not None:
        gone = dismissed.select(F.col("user_id").alias("gone_user"), content_stems("text").alias("gone"))
        now = now.join(gone, (F.col("user_id") == F.col("gone_user")) & same_thread("words", "gone"), "left_anti")
    past = t.where("night > 1").select("user_id", "day", "night", F.col("words").alias("then"))
    seen = now.join(past, "user_id").where(same_thread("words", "then")).select("user_id", "text", "night", "day").distinct()
    run = seen.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "text").orderBy("night"))).where("night = k + 1")
    run = run.groupBy("user_id", "text").agg(F.count("*").alias("before"), F.min("day").alias("first"))
    out = now.join(run, ["user_id", "text"], "left").select("user_id", "text", F.coalesce("first", "latest").alias("first_seen"), (F.coalesce("before", F.lit(0)) + 1).alias("nights"), "latest")
    out = out.withColumn("days_open", F.datediff("latest", "first_seen") + 1).drop("latest")
    w = Window.partitionBy("user_id").orderBy(F.desc("days_open"), F.desc("nights"), "text")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


_SHARES = "len(list_intersect({0}, {1})) >= 2 AND len(list_intersect({0}, {1})) >= 0.5 * least(len({0}), len({1}))"


@query("open_threads", f"WITH t AS MATERIALIZED (SELECT *, list_distinct({_STEM}) AS words, dense_rank() OVER (PARTITION BY user_id ORDER BY day DESC) AS night FROM (SELECT DISTINCT conv_id % 3 AS user_id, (TIMESTAMP '2024-01-01' + to_hours(conv_id))::DATE AS day, text FROM conversations WHERE role = 'user' AND text IS NOT NULL) QUALIFY night <= 30), "
       f"seen AS (SELECT DISTINCT n.user_id, n.text, p.night, p.day FROM t n JOIN t p ON n.user_id = p.user_id AND n.night = 1 AND p.night > 1 WHERE {_SHARES.format('n.words', 'p.words')}), "
       "run AS (SELECT user_id, text, count(*) AS before, min(day) AS first FROM (SELECT *, row_number() OVER (PARTITION BY user_id, text ORDER BY night) AS k FROM seen) WHERE night = k + 1 GROUP BY 1, 2) "
       "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days_open DESC, nights DESC, text) AS rank FROM (SELECT t.user_id, t.text, coalesce(first, t.day) AS first_seen, coalesce(before, 0) + 1 AS nights, date_diff('day', coalesce(first, t.day), t.day) + 1 AS days_open FROM t LEFT JOIN run ON run.user_id = t.user_id AND run.text = t.text WHERE night = 1) QUALIFY rank <= 8")
def open_threads_q(spark, sf_dir) -> DataFrame:
    """The user turns of each day stand for the lines of that night's summary, of three users."""
    day = F.to_date(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, conv_id, 0, 0)"))
    return open_threads(table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") % 3).alias("user_id"), day.alias("day"), "text"))


def salient_lines(text: str | Column = "text", most: int = SALIENT) -> Column:
    """TXT-8: the lines of a text that say most: distinct words of three letters or more and a bit for length.

    Of lines whose first KEY_CHARS letters and digits hold one another the first stays; menu bars, links and bullets go.
    Null for a null text, an empty array where no line is left.
    """
    low, high = LINE_CHARS
    name = text if isinstance(text, str) else "text"
    lines = F.filter(clean_lines(name), lambda x: F.length(x).between(low, high) & ~F.lower(x).rlike(r"^(file edit|http)") & ~F.substring(x, 1, 3).contains("•"))
    keyed = F.transform(lines, lambda x: F.struct(F.left(F.regexp_replace(F.lower(x), "[^a-z0-9 ]", ""), F.lit(KEY_CHARS)).alias("key"), x.alias("line")))
    none = F.array().cast("array<struct<key:string,line:string>>")
    kept = F.aggregate(keyed, none, lambda acc, x: F.when(F.exists(acc, lambda s: s.key.contains(x.key) | x.key.contains(s.key)), acc).otherwise(F.concat(acc, F.array(x))))
    words = lambda x: F.size(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z]{3,})"), F.lit(1))))
    scored = F.transform(kept, lambda x, i: F.struct((-(words(x.line) + F.length(x.line) / 60.0)).alias("score"), i.alias("at"), x.line.alias("line")))
    return F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: x.line)


@query("salient_lines")
def salient_lines_q(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(salient_lines("text")).alias("rank", "line"))


def identity_of_address(address: Column) -> Column:
    """TXT-28: what an address says of its owner; null where it says nothing."""
    a = F.lower(address)
    return F.when(a.rlike(SCHOOL), "school").when(a.rlike(PERSONAL), "personal")


def document_identity(text: str = "text") -> Column:
    """GRA-6: the identity of a document: that of its addresses if they agree; without any, the strict leader of distinct phrases.

    Null for several identities, ties, no evidence, and documents that belong to all (named as such in their first 300 characters).
    """
    t = col(text)
    said = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(t, F.lit(f"({ADDRESS})"), F.lit(1)), identity_of_address), lambda x: x.isNotNull()))
    n = {k: F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(p), F.lit(1)))) for k, p in VOTES.items()}
    voted = F.when(n["school"] > n["work"], "school").when(n["work"] > n["school"], "work")
    shared = F.lower(F.left(t, F.lit(300))).rlike(SHARED_DOCUMENT)
    return F.when(shared, None).when(F.size(said) == 1, F.get(said, F.lit(0))).when(F.size(said) == 0, voted)


_SAID = f"list_distinct(list_filter(list_transform(regexp_extract_all(text, '{ADDRESS}'), lambda a: CASE WHEN regexp_matches(lower(a), '{SCHOOL}') THEN 'school' WHEN regexp_matches(lower(a), '{PERSONAL}') THEN 'personal' END), lambda x: x IS NOT NULL))"
_VOTED = {k: f"len(list_distinct(regexp_extract_all(lower(text), '{p}', 1)))" for k, p in VOTES.items()}


@query("document_identity", f"SELECT doc_id, CASE WHEN regexp_matches(lower(left(text, 300)), '{SHARED_DOCUMENT}') THEN NULL WHEN len(said) = 1 THEN said[1] WHEN len(said) = 0 THEN CASE WHEN s > w THEN 'school' WHEN w > s THEN 'work' END END AS identity FROM (SELECT doc_id, text, {_SAID} AS said, {_VOTED['school']} AS s, {_VOTED['work']} AS w FROM documents)")
def document_identity_q(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", document_identity().alias("identity"))


def line_identities(docs: DataFrame, most: int = 30) -> DataFrame:
    """GRA-7: (doc_id, line, identity) for documents of 30 lines at most that hold two identities or more; others give no row."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    short = docs.select("doc_id", "text", lines.alias("lines")).where((F.size("lines") <= most) & ~F.lower(F.left("text", F.lit(300))).rlike(SHARED_DOCUMENT))
    named = short.withColumn("ids", F.transform("lines", lambda x: identity_of_address(F.nullif(F.regexp_extract(x, f"({ADDRESS})", 1), F.lit("")))))
    two = named.where(F.size(F.array_distinct(F.filter("ids", lambda x: x.isNotNull()))) >= 2)
    return two.select("doc_id", F.explode(F.filter(F.zip_with("lines", "ids", lambda a, b: F.struct(a.alias("line"), b.alias("identity"))), lambda x: x.identity.isNotNull())).alias("x")).select("doc_id", "x.*")


_LINE_ID = f"CASE WHEN regexp_matches(lower(a), '{SCHOOL}') THEN 'school' WHEN regexp_matches(lower(a), '{PERSONAL}') THEN 'personal' END"
_PLANTED = "concat_ws(chr(10), CASE WHEN doc_id % 3 = 0 THEN 'write to ada@gmail.com' WHEN doc_id % 3 = 1 THEN 'Ada@Uni.EDU, or ada@icloud.com' END, text, CASE WHEN doc_id % 2 = 0 THEN '  bob.b@college.edu  ' END)"


@query("line_identities", f"SELECT doc_id, x.line AS line, x.identity AS identity FROM (SELECT doc_id, unnest(list_filter(ids, lambda x: x.identity IS NOT NULL)) AS x FROM (SELECT doc_id, list_transform(ls, lambda l: {{'line': l, 'identity': (list_transform([regexp_extract(l, '{ADDRESS}')], lambda a: {_LINE_ID}))[1]}}) AS ids FROM "
       f"(SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ls FROM (SELECT doc_id, {_PLANTED} AS t FROM documents)) WHERE len(ls) <= 30 AND NOT regexp_matches(lower(left(t, 300)), '{SHARED_DOCUMENT}')) WHERE len(list_distinct(list_filter(list_transform(ids, lambda x: x.identity), lambda i: i IS NOT NULL))) >= 2)")
def line_identities_q(spark, sf_dir) -> DataFrame:
    """GRA-7 over documents, some with lines that name an address."""
    i = F.col("doc_id")
    first = F.when(i % 3 == 0, "write to ada@gmail.com").when(i % 3 == 1, "Ada@Uni.EDU, or ada@icloud.com")
    return line_identities(table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", first, "text", F.when(i % 2 == 0, "  bob.b@college.edu  ")).alias("text")))
