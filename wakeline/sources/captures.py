"""The fact table and its companions, read from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import page_key
from .scratch import among


ASKERS = 15
#: Captures of a task that reads texts: without a number of its own Spark deals them by the bytes of the keys, which are few.
TEXTS_A_TASK = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str, text: bool = False, vectors: bool = False, keyed: bool = False, made: dict[str, Column] | None = None, only: DataFrame | None = None, beside: DataFrame | None = None) -> DataFrame:
    """captures (capture_id, user_id, ts, app, window_title, url[, ocr_text][, made columns][, embedding][, page_key][, columns of beside]).

    made names columns over ocr_text that are made once a document, before captures meet it; one named ocr_text stands for the text.  only (capture_id), a
    written table of distinct ids, keeps those captures before anything is joined to them; beside (capture_id, ...), another such table, does so and its columns ride along.

    Texts and vectors are joined in only where asked for, so that a dwell report never reads them.  The tables' sizes are subqueries of the plan.
    Texts come last, so that none is shuffled for another table, in tasks of TEXTS_A_TASK captures.
    """
    t = lambda name: table(spark, sf_dir, name)
    size = lambda name: t(name).select(F.count("*")).scalar()
    kind = F.col("event_type")
    app = F.when(kind.isin("click", "view"), "Browser").when(kind == "error", "Terminal").when(kind == "signup", "Mail").otherwise("Notes")
    events = t("events") if only is None else among(t("events"), only.select(F.col("capture_id").alias("event_id")), ["event_id"])
    rest = [] if beside is None else [c for c in beside.columns if c != "capture_id"]
    if beside is not None:
        events = events.join(beside.withColumnRenamed("capture_id", "event_id").hint("merge"), "event_id")
    e = events.select(*rest, "event_id", "user_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), app.alias("app"), ((F.col("user_id") * 5 + F.col("event_id") % 5) % size("pages")).alias("page_ix"))
    s = lambda c: c.cast("string")
    item = F.concat(F.col("app"), F.lit(" item "), s(F.col("event_id") % 3))
    title = F.when(F.col("app") == "Browser", F.concat(F.lit("("), s(F.col("event_id") % 7), F.lit(") Page "), s(F.col("page_ix")))).when(F.col("event_id") % 4 == 0, F.concat(item, F.lit(" ("), s(F.col("event_id") % 9), F.lit(")"))).otherwise(item)
    df = e.join(t("pages").select(F.col("page_id").alias("page_ix"), "url"), "page_ix").withColumn("window_title", title).withColumn("url", F.when(F.col("app") == "Browser", F.col("url")))
    cols = ["capture_id", "user_id", "ts", "app", "window_title", "url", *(["ocr_text"] if text else []), *(c for c in made or {} if not (text and c == "ocr_text")), *(["embedding"] if vectors else []), *rest]
    if vectors:
        vec = t("embeddings").select(F.col("vec_id").alias("vec_ix"), "embedding")
        df = df.withColumn("vec_ix", (F.col("page_ix") * 7 + F.col("event_id") % 3) % size("embeddings")).join(vec, "vec_ix")
    if text or made:
        docs = t("documents").select(F.col("doc_id").alias("doc_ix"), F.col("text").alias("ocr_text"))
        docs = docs.select("doc_ix", *(["ocr_text"] if text and "ocr_text" not in (made or {}) else []), *(c.alias(name) for name, c in (made or {}).items()))
        tasks = -(-(beside if beside is not None else only if only is not None else t("events")).count() // TEXTS_A_TASK) or 1
        df = df.withColumn("doc_ix", (F.col("event_id") * 31 + F.col("user_id")) % size("documents")).repartition(tasks, "doc_ix").join(docs, "doc_ix")
    df = df.withColumnRenamed("event_id", "capture_id").select(*cols)
    return df.withColumn("page_key", page_key()) if keyed else df


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of ASKERS users: (query_id, user_id, text, ts, embedding).  A user has two vectors, so users ask again, at once and days later."""
    vec = table(spark, sf_dir, "embeddings")
    c = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("user_id", F.col("conv_id") % ASKERS)
    ts = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, conv_id * 37 + turn, 0)")
    vec_id = (F.col("user_id") * 11 + F.floor(F.col("turn") / 4) % 2) % vec.select(F.count("*")).scalar()
    q = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "user_id", "text", ts.alias("ts"), vec_id.alias("vec_id"))
    return q.join(vec.select("vec_id", "embedding"), "vec_id").select("query_id", "user_id", "text", "ts", "embedding")


#: Lines planted in the notes, one by one over the captures; some hold the capture's own number.
NOTE_LINES = (
    "I'll send the report to Dana by Friday", "please reply to the landlord by tomorrow", "I need to call the bank about the loan", "need to email the professor tonight", "Submit the tax form this week",
    "I might send you the photos at some point", "Sent the report to Dana as agreed", "My weight today: {weight} kg", "Resting heart rate {rate}", "Score: {score}%", "Up to $20 on selected pages", "Order 1234567 of 2024", "Daily steps {steps}",
)
NOTES_SQL = f"notes_v AS (SELECT capture_id, user_id, ts, app, url, page_key, capture_id % {len(NOTE_LINES)} AS k FROM keyed)"


def notes(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Captures (of some ids, as in :func:`captures`) with a message: (capture_id, user_id, ts, app, url, page_key, body), a planted line before the captured text."""
    df = captures(spark, sf_dir, text=True, keyed=True, only=only)
    return df.select("capture_id", "user_id", "ts", "app", "url", "page_key", F.concat_ws("\n", note_line(), "ocr_text").alias("body"))


def note_line() -> Column:
    """The planted line of a capture's note."""
    i = F.col("capture_id")
    line = F.element_at(F.array(*map(F.lit, NOTE_LINES)), (i % len(NOTE_LINES) + 1).cast("int"))
    for name, value in {"weight": (60 + i % 40 + 0.5).cast("decimal(5,1)"), "rate": 50 + i % 30, "score": 1 + i % 99, "steps": 1000 + i % 800}.items():
        line = F.replace(line, F.lit("{" + name + "}"), value.cast("string"))
    return line
