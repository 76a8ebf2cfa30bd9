"""Facts that trusted documents state about their owner: typed values, values on the next line, and labelled lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import tokens
from ..plans.catalog import over_captures, query
from ..sources.captures import query_log, table
from .filters import STOP_WORDS

# The words that name a kind of fact, and what its value looks like (an address is what stands behind a colon).
KINDS = {"phone": ("phone", "number", "cell", "mobile"), "email": ("email", "e-mail", "mail"), "address": ("address", "street", "live"), "birthday": ("birthday", "birth", "born", "dob")}
VALUES = {
    "phone": r"(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b",
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
    "birthday": r"(?i)(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2},? \d{4})",
}
LONGEST = 120


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _by_kind(kind: Column, of) -> Column:
    """The column that of(kind) gives for the row's kind; null without one."""
    out = F.lit(None)
    for k in KINDS:
        out = F.when(kind == k, of(k)).otherwise(out)
    return out


def _hits(terms: Column, text: Column) -> Column:
    return F.size(F.filter(terms, lambda t: text.contains(t)))


def fact_answers(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """JN-14: (query_id, value, path): what the documents (user_id, path, content) of a question's user say about a fact that it asks for.

    Questions (query_id, user_id, text) without "my" ask for none.  First come lines that name the fact's kind and hold a value of it, the line with most of
    the question's words first; then values on the line below; then the labelled line whose label holds most of the words behind "my" (two, where
    there are two).  Ties go to the first document by path and then the first line.  A null text or content gives none.
    """
    low = F.lower("text")
    kind = F.lit(None).cast("string")
    for k, words in reversed(KINDS.items()):
        kind = F.when(_any(low, words), k).otherwise(kind)
    plain = lambda x: F.filter(tokens(x, 2), lambda w: ~w.isin(*STOP_WORDS))
    q = questions.where(low.contains("my")).select("query_id", "user_id", low.alias("q"), kind.alias("kind"), plain("text").alias("terms"), plain(F.regexp_extract(low, r"\bmy\s+(.{2,50}?)(?:\?|$)", 1)).alias("asked"))
    rows = F.transform(F.split("content", r"\r?\n"), lambda x, i: F.struct(i.alias("row"), x.alias("line")))
    lines = documents.select("user_id", "path", rows.alias("r")).select("user_id", "path", "r", F.explode("r").alias("x"))
    lines = lines.select("user_id", "path", "x.row", "x.line", F.coalesce(F.get("r", F.col("x.row") + 1)["line"], F.lit("")).alias("below"))
    # no other line can name a fact
    lines = lines.where(F.col("line").contains(":") | _any(F.lower("line"), tuple(w for words in KINDS.values() for w in words)))
    p = q.join(lines.hint("merge"), "user_id").withColumns({"l": F.lower("line"), "label": F.lower(F.substring_index("line", ":", 1))})
    named = F.coalesce(_by_kind(F.col("kind"), lambda k: _any(F.col("l"), KINDS[k])), F.lit(False))
    value = lambda text: _by_kind(F.col("kind"), lambda k: F.nullif(F.trim(F.regexp_extract(text, VALUES[k], 0)), F.lit("")) if k in VALUES else F.lit(None).cast("string"))
    behind = F.when(F.col("line").contains(":"), F.nullif(F.trim(F.regexp_replace("line", r"^[^:]*:", "")), F.lit("")))
    other = (F.col("kind") == "address") & F.col("l").rlike(r"e-?mail")
    typed = F.when(named & ~other, F.coalesce(value("line"), F.when(F.col("kind") == "address", behind)))
    next_line = F.when(named, value("below"))
    mail, phone = _any(F.col("label"), ("email", "e-mail")) & ~_any(F.col("q"), KINDS["email"]), F.col("label").contains("phone") & ~_any(F.col("q"), ("phone", "number"))
    hits = _hits(F.col("asked"), F.col("label"))
    labelled = F.when((F.length(behind) <= LONGEST) & ~mail & ~phone & (hits >= F.least(F.size("asked"), F.lit(2))) & (hits > 0), behind)
    none = F.lit(0)
    found = [(0, -_hits(F.col("terms"), F.col("l")), typed), (1, none, next_line), (2, -hits, labelled)]
    every = F.filter(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(s).alias("stage"), score.cast("int").alias("score"), F.col("path"), F.col("row"), v.alias("value"))) for s, score, v in found)), lambda x: x.isNotNull())
    best = p.select("query_id", F.explode(every).alias("x")).groupBy("query_id").agg(F.min("x").alias("x"))
    return best.select("query_id", "x.value", "x.path")


def owner_answers(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """JN-16: (query_id, owner, shared, rank, value): each owner's own answer in the order of their names, then the shared one; equal values once, by the first.

    documents (user_id, owner, path, content): a null owner's are everyone's.
    """
    asked = questions.join(documents.select("user_id", F.coalesce("owner", F.lit("")).alias("owner")).distinct(), "user_id")
    one = asked.select(F.struct("query_id", "owner").alias("query_id"), F.struct("user_id", "owner").alias("user_id"), "text")
    got = fact_answers(one, documents.select(F.struct("user_id", F.coalesce("owner", F.lit("")).alias("owner")).alias("user_id"), "path", "content"))
    got = got.select("query_id.query_id", "query_id.owner", (F.col("query_id.owner") == "").alias("shared"), "value")
    order = F.struct("shared", "owner")
    got = got.withColumn("k", F.row_number().over(Window.partitionBy("query_id", F.lower("value")).orderBy(order))).where("k = 1").drop("k")
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order))).withColumn("owner", F.nullif("owner", F.lit("")))


QUESTIONS = ("What is my phone number?", "what's my email", "What is my home address?", "when is my birthday", "What is my membership plan?", "What is my shoe size?", "Where is the phone?")


def _sheets(spark, sf_dir) -> DataFrame:
    """A contact sheet for each customer; customer k is user k's."""
    s = lambda c: F.col(c).cast("string")
    k = s("c_custkey")
    content = F.concat(F.lit("Contact sheet of "), "c_name", F.lit("\nPhone number: (619) 555-"), F.lpad(k, 4, "0"), F.lit("\nSchool email address: u"), k, F.lit("@school.edu\nHome address: "), k, F.lit(" Main St, Nation "), s("c_nationkey"), F.lit("\nBirthday\n03/1"), F.col("c_custkey") % 10, F.lit("/1990\nMembership plan: "), "c_mktsegment")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("sheets/"), k).alias("path"), content.alias("content"))


def _fact_questions(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("query_id") % len(QUESTIONS) + 1).cast("int"))
    return query_log(spark, sf_dir).select("query_id", "user_id", kind.alias("text"))


_KIND = f"query_id % {len(QUESTIONS)}"
_VALUE = f"CASE {_KIND} WHEN 0 THEN '(619) 555-' || lpad(CAST(user_id AS VARCHAR), 4, '0') WHEN 1 THEN 'u' || user_id || '@school.edu' WHEN 2 THEN user_id || ' Main St, Nation ' || c_nationkey WHEN 3 THEN '03/1' || user_id % 10 || '/1990' ELSE c_mktsegment END"


@query("fact_answers", over_captures(f"SELECT query_id, {_VALUE} AS value, 'sheets/' || user_id AS path FROM queries_v JOIN customer ON c_custkey = user_id WHERE {_KIND} < 5"))
def fact_answers_q(spark, sf_dir) -> DataFrame:
    """JN-14 over contact sheets and five kinds of questions; two more have no answer."""
    return fact_answers(_fact_questions(spark, sf_dir), _sheets(spark, sf_dir))


@query("owner_answers", over_captures(f"SELECT query_id, CASE WHEN r = 1 THEN 'home' END AS owner, r = 2 AS shared, r AS rank, CASE WHEN r = 2 AND {_KIND} = 0 THEN '(619) 555-9999' ELSE {_VALUE} END AS value FROM queries_v JOIN customer ON c_custkey = user_id CROSS JOIN (VALUES (1), (2)) v(r) WHERE {_KIND} < 5 AND (r = 1 OR {_KIND} = 0)"))
def owner_answers_q(spark, sf_dir) -> DataFrame:
    """JN-16: the sheets are of two owners, home and work, with the same values, and one shared sheet holds another phone number."""
    sheets = _sheets(spark, sf_dir)
    both = sheets.withColumn("owner", F.explode(F.array(F.lit("home"), F.lit("work"))))
    shared = sheets.select("user_id", F.lit("shared").alias("path"), F.lit("Front desk phone: (619) 555-9999").alias("content"), F.lit(None).cast("string").alias("owner"))
    return owner_answers(_fact_questions(spark, sf_dir), both.unionByName(shared))
