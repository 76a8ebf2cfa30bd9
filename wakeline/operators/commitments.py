"""Commitments and numbers in captured text: what was promised, whether it was kept, and the values that labels name."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import body, lines_of, sentences
from ..plans.catalog import over_captures, query
from ..sources.captures import NOTE_LINES, NOTES_SQL, captures, note_line, notes
from ..sources.scratch import among, written
from .filters import NOISE_KEY, source_class
from .folds import fold_rows
from .memory import vague_due

# Verbs, openers, anchors and rejects that decide what a commitment is.
VERB = (
    "(?:send|sends|sending|reply|replies|replying|respond|email|finish|submit|review|call|share|deliver|sign|return|pay|get back|follow up|circle back|send over|get you|send you|schedule|book|invite|"
    "buy|order|remind|update|write|draft|prepare|ask|meet|ping|dm|confirm|cancel|renew|complete|upload|fix|merge|approve|set up|reach out|text|message)"
)
TAIL = '[^.?!\\n,;"“”|]{0,45}'
ME = rf"(?i)\b(?:i'?ll|i will|i'?m going to|i'?m gonna|i plan to|i need to|i have to|i gotta|gotta|i must|remember to|don'?t forget to)\b[^.?!\n,;]*?\b{VERB}\b{TAIL}"
ME_WEAK = rf"(?i)\b(?:need to|have to)\b[^.?!\n,;]*?\b{VERB}\b{TAIL}"
THEM = rf"(?i)\b(?:please|can you|could you|make sure to)\b[^.?!\n,;]*?\b{VERB}\b{TAIL}"
IMPERATIVE = (
    "(?i)^\\s*(?:email|send|call|text|message|reply|respond|finish|submit|review|schedule|book|invite|buy|order|pay|remind|update|write|draft|prepare|share|ask|follow up|circle back|meet|ping|dm|confirm|cancel|"
    'renew|complete|upload|fix|merge|approve|set up|reach out|get)\\b[^.?!\\n,;"“”|]{3,55}'
)
DEADLINE = (
    r"(?i)\b(?:by|before|due(?: on)?|no later than)\s+(?:the\s+)?(?:end of\s+(?:the\s+)?(?:day|week|today|month)|eod|cob|eow|end of day|today|tonight|tomorrow|this week|next week|this weekend|"
    r"mon|tue|wed|thu|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|\d{1,2}(?:st|nd|rd|th)?)|\bend of (?:the\s+)?(?:day|week|today|month)\b"
)
TEMPORAL = (
    r"(?i)\b(?:today|tonight|tonite|tomorrow|tmrw|this (?:week|weekend|afternoon|evening|morning)|next (?:week|month)|end of (?:the )?(?:day|week|today|month)|eod|eow|cob|"
    r"mon|tue|wed|thu|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
)
NEGATION = r"(?i)\b(?:won'?t|will not|wouldn'?t|not going to|no need to|don'?t have to|never|can'?t|cannot|couldn'?t)\b"
HEDGE = (
    r"(?i)\b(?:if [il1]\b|might|maybe|thinking about|was going to|want to do is|wondering|considering|not sure|probably should|i'?ll try|i'?ll probably|try to|hope to|hoping to|aim to|"
    r"i'?ll see if|i'?ll try to|if i get|when i get a chance|at some point)\b"
)
ADVERT = r"(?i)\b(?:discounts?|deals?|offers?|free|% ?off|\d+% |sale|instant|exclusive|save \$?\d|best price|limited time|shop now|subscribe|sign up|upgrade now|premium|trial|unlock)\b"
INSTRUCTION = r"(?i)\b(?:your|you will|you'?ll need|you must|you should)\b"
CLIPPED = r"(?i)\b(?:of|to|the|a|an|for|with|and|or|that|if|is|are|by|on|at|in|from|instead|as|was|be|can|will|would|could|should|must|my|me|it)$"
QUESTION = r"(?i)^\s*(?:will|can|could|would|should|do|does|did|am|are|is)\b"
REMINDER = r"(?i)^\s*(?:remember to|don'?t forget to)"
DONE = r"(?i)\b(?:sent|emailed|mailed|submitted|delivered|shared|replied|responded|finished|completed|done|paid|booked|scheduled|shipped|uploaded|posted|messaged|dm'?d|texted|called|signed|returned|confirmed|merged|approved)\b"
DONE_STOP = ("the", "a", "an", "to", "of", "for", "with", "and", "or", "that", "this", "you", "your", "me", "my", "it", "is", "are", "be", "by", "on", "at", "in", "from", "will", "i'll", "ill", "send", "back", "get", "do", "can")
#: What a text, and a sentence of it, must hold to have one of the shapes above: an opener, or a verb and a time.
OPENER = r"(?i)\b(?:i'?ll|i will|i'?m going to|i'?m gonna|i plan to|need to|have to|gotta|i must|remember to|don'?t forget to|please|can you|could you|make sure to)\b"
VERBS = (
    "email", "send", "call", "text", "message", "reply", "respond", "finish", "submit", "review", "schedule", "book", "invite", "buy", "order", "pay", "remind", "update", "write", "draft", "prepare", "share", "ask", "follow up", "circle back", "meet",
    "ping", "dm", "confirm", "cancel", "renew", "complete", "upload", "fix", "merge", "approve", "set up", "reach out", "get",
)
ORDERED = r"(?i)\b(?:" + "|".join(VERBS) + r")\b"
#: A plain piece of each opener.
OPENED = ("i'll", "ill", "i will", "m going to", "m gonna", "i plan to", "need to", "have to", "gotta", "i must", "remember to", "t forget to", "please", "can you", "could you", "make sure to")
BARS = {"authored": 0.70, "strict": 0.80}
BASE = {"me": 0.55, "weak": 0.55, "them": 0.45, "imperative": 0.45}
TRUST, STRICT_TIME, SOME_TIME = 0.15, 0.25, 0.15
SAME, FORGET_DAYS = 0.8, 14

# The shape of a labelled number, and the labels that are and are not measures of a person.
PAIR = r"([A-Za-z][A-Za-z ]{2,28}?)\s*[:=]?\s*([$€£])?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(%|kg|lbs?|hrs?|hours?|mins?|GB|MB|pts?|points?)?"
SECRET_LABEL = r"(?i)\b(card|cvv|cvc|ssn|pin|password|passcode|otp|code|account|routing|phone|zip|id)\b"
CHROME_LABEL = r"(?i)\b(file|edit|view|tabs?|bookmarks?|history|extensions?|window|help|format|selection|develop|terminal|toolbar|menu|favorites?|profiles?|thought|episode|season|sonnet|opus|haiku|gpt|claude|version|chapter)\b"
JUNK_LABEL = r"(?i)\b(views?|subscribers?|likes?|comments?|commented|watching|ago|label|followers?|shares?d?|upvotes?|replies|reposts?)\b|^[kmb]\b"
METRICS = (
    "weight", "bodyweight", "bmi", "grade", "gpa", "score", "sleep", "streak", "steps", "calorie", "calories", "cal", "cals", "kcal", "macros", "protein", "carbs",
    "heart", "rate", "bpm", "pulse", "hydration", "hrv", "spo2", "rank", "elo", "rating", "level", "reps", "sets", "pace", "mileage", "temperature", "temp", "streaks",
)
MODIFIERS = ("my", "the", "your", "our", "current", "total", "today", "todays", "now", "this", "week", "weekly", "daily", "avg", "average", "resting", "max", "min", "goal", "value", "latest", "so", "far")
NUMBERS_A_CAPTURE = 8


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later filters read: without the explode of one row Spark puts their expressions into each filter, once for each mention."""
    one = F.explode_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once")
    return df.select("*", one).select(*df.columns, "_once.*")


def tidy(s: Column) -> Column:
    """A phrase with single blanks, cut at a dash, bar or bullet between blanks and at the first word outside ASCII, without marks around it."""
    one = F.trim(F.regexp_replace(s, r"\s+", " "))
    one = F.regexp_replace(F.regexp_replace(one, r"\s+[-–—•|›»:]\s+.*$", ""), r"\s+[^\x00-\x7F].*$", "")
    return F.left(F.regexp_replace(one, "^[ \\-–—•|:\"']+|[ \\-–—•|:\"']+$", ""), F.lit(140))


def plain_key(s: str | Column) -> Column:
    return F.left(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9 ]", "")), F.lit(60))


def commitments(captures: DataFrame, text: str = "body") -> DataFrame:
    """TXT-12: (capture_id, user_id, ts, app, url, text) to (capture_id, user_id, ts, trust, at, who, what, due, confidence).

    Sentences of the message's own lines are looked through for four shapes in order: the writer's promise, a weak one with a time, a request,
    and an order with a time.  Questions, negations, hedges, adverts and clipped phrases go; of phrases of a capture that hold one another the
    first stays.  A deadline is told from the capture's day.  Blocked surfaces and null texts give none.

    Texts, and then sentences, that can hold no shape go first, by a search for openers and verbs: the patterns meet few sentences.
    """
    return promised(captures.where(may_promise(F.col(text))), promising(text))


def promised(captures: DataFrame, said: Column) -> DataFrame:
    """:func:`commitments` of captures with :func:`promising` sentences, which a text that many captures share gives once."""
    c = captures.withColumn("trust", source_class()).where("trust <> 'blocked'")
    # outer: for a plain explode Spark makes the sentences once more to see whether there are any
    s = c.select("capture_id", "user_id", "ts", "trust", F.explode_outer(said).alias("x")).where("x IS NOT NULL").select("capture_id", "user_id", "ts", "trust", "x.at", "x.s")
    s = once(s, strict=F.col("s").rlike(DEADLINE))
    s = once(s, timed=F.col("strict") | F.col("s").rlike(TEMPORAL))
    found = lambda pattern: F.nullif(F.regexp_extract("s", pattern, 0), F.lit(""))
    timed = lambda pattern: F.when(F.col("timed"), found(pattern))
    s = once(s, me=found(ME), weak=timed(ME_WEAK), them=found(THEM), imperative=timed(IMPERATIVE))
    shape = F.when(F.col("me").isNotNull(), "me").when(F.col("weak").isNotNull(), "weak").when(F.col("them").isNotNull(), "them").when(F.col("imperative").isNotNull(), "imperative")
    s = once(s.withColumn("shape", shape).where("shape IS NOT NULL"), what=tidy(F.coalesce("me", "weak", "them", "imperative")), whole=tidy(F.col("s")))
    rest = F.substr("whole", F.length("what") + 1)
    cut = F.col("whole").startswith(F.col("what")) & rest.rlike(r"^\p{L}") & F.col("what").contains(" ")
    s = once(s, short=F.when(cut, F.regexp_replace("what", r" [^ ]*$", "")).otherwise(F.col("what"))).drop("what").withColumnRenamed("short", "what")
    n = F.size(F.split("what", " "))
    bad = F.col("s").contains("?") | F.col("s").rlike(QUESTION) | F.col("s").rlike(NEGATION) | F.col("s").rlike(HEDGE) | F.col("s").rlike(ADVERT)
    bad = bad | (((F.col("shape") == "imperative") | F.col("s").rlike(REMINDER)) & F.col("s").rlike(INSTRUCTION)) | ~n.between(3, 16) | F.col("what").rlike(CLIPPED)
    s = s.where(~bad).withColumn("key", plain_key("what")).where("length(key) >= 6")
    score = F.lit(0.0)
    for name, value in BASE.items():
        score = F.when(F.col("shape") == name, value).otherwise(score)
    score = score + F.when(F.col("trust") == "authored", TRUST).otherwise(0.0) + F.when(F.col("strict"), STRICT_TIME).when(F.col("timed"), SOME_TIME).otherwise(0.0)
    them = F.col("shape") == "them"
    due = F.when(F.col("timed") & (~them | F.col("strict")), vague_due("s", "ts"))
    one = F.struct("at", F.when(them, "them").otherwise("me").alias("who"), "what", due.alias("due"), F.round(F.least(score, F.lit(0.99)), 2).alias("confidence"), "key")
    every = s.groupBy("capture_id", "user_id", "ts", "trust").agg(F.array_sort(F.collect_list(one)).alias("a"))
    none = F.slice("a", 1, 0)
    kept = F.aggregate("a", none, lambda acc, x: F.when(F.exists(acc, lambda k: k.key.contains(x.key) | x.key.contains(k.key)), acc).otherwise(F.concat(acc, F.array(x))))
    return every.select("capture_id", "user_id", "ts", "trust", F.explode(kept).alias("x")).select("capture_id", "user_id", "ts", "trust", "x.at", "x.who", "x.what", "x.due", "x.confidence")


def promising(text: str | Column) -> Column:
    """A text's sentences that may promise, each with its place among all of them."""
    return F.filter(F.transform(sentences_of(text), lambda x, i: F.struct(i.alias("at"), x.alias("s"))), lambda x: may_promise(x.s))


def of_notes(said: str) -> Column:
    """Promising sentences of notes: of the planted line, then those of the captured text (said), which was looked through once a document.  No sentence spans both, as
    a line's end parts them."""
    rest = F.transform(F.coalesce(said, F.array().cast("array<struct<at:int,s:string>>")), lambda x: F.struct((x.at + F.size(sentences_of("line"))).alias("at"), x.s.alias("s")))
    return F.concat(F.when(may_promise(F.col("line")), promising("line")).otherwise(F.array().cast("array<struct<at:int,s:string>>")), rest)


def may_promise(text: Column) -> Column:
    """Whether a line holds what each of the four shapes needs; most are told by plain pieces, and the patterns meet few lines."""
    any_of = lambda low, words: reduce(or_, (low.contains(w) for w in words))
    lines = F.filter(F.split(text, "\n"), lambda x: F.exists(F.array(F.lower(x)), lambda low: any_of(low, OPENED + VERBS)))
    return F.exists(lines, lambda x: x.rlike(OPENER) | (x.rlike(ORDERED) & (x.rlike(TEMPORAL) | x.rlike(DEADLINE))))


def sentences_of(text: str | Column) -> Column:
    own = body(text)
    pieces = F.filter(F.transform(F.split(own, r"[.?!\n]|\s{2,}|\s+[-–—•|›]\s+"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: F.length(x).between(8, 200))
    return F.filter(pieces, lambda x: F.size(F.regexp_extract_all(x, F.lit("([a-zA-Z]{2,})"), F.lit(1))) >= 3)


def storable(found: DataFrame, most: int = 2) -> DataFrame:
    """WIN-7: a capture's first commitments of those that clear the bar of its surface."""
    bar = F.when(F.col("trust") == "authored", BARS["authored"]).otherwise(BARS["strict"])
    first = Window.partitionBy("capture_id").orderBy("at")
    return found.where(F.col("confidence") >= bar).withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).drop("k")


@lru_cache(maxsize=65_536)
def _alike(a: str, b: str) -> bool:
    """The same phrases come again and again; the quick ratios are never below the ratio."""
    if a in b or b in a:
        return True
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() > SAME and m.quick_ratio() > SAME and m.ratio() > SAME


def new_commitments(found: DataFrame) -> DataFrame:
    """JN-10, STR-4: commitments in the order of time without those like one that the user made in the last FORGET_DAYS days.

    A state holds the user's commitments of those days only.
    """
    rows = found.withColumn("_key", plain_key("what")).withColumn("_sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    return fold_rows(rows, ["user_id"], ["ts", "capture_id", "at"], ["_key", "_sec"], list, new_promise).drop("_key", "_sec")


def new_promise(state: list, row: tuple) -> bool:
    """Whether (key, second) is like none of the state's, which are those of the last FORGET_DAYS days."""
    key, sec = row
    state[:] = [(k, s) for k, s in state if sec - s <= FORGET_DAYS * 86400]
    if any(_alike(key, k) for k, _ in state):
        return False
    state.append((key, sec))
    return True


def kept_promises(made: DataFrame, captures: DataFrame, text: str = "body") -> DataFrame:
    """JN-11: (user_id, capture_id, what, closed_at): commitments closed by a later authored capture that says something is done and holds two
    of their first five distinctive words.  Words that no commitment has go before anything is shuffled."""
    words = F.filter(F.split(plain_key("what"), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*DONE_STOP))
    open_ = made.select("user_id", "capture_id", "ts", "what", F.explode(F.array_distinct(F.slice(words, 1, 5))).alias("word"))
    open_ = written(open_, "open")
    done = captures.where((source_class() == "authored") & body(text).rlike(DONE)).select("user_id", F.col("ts").alias("done_ts"), F.col("capture_id").alias("done_id"), F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower(body(text)), "[^a-z0-9 ]", " "), r"\s+"))).alias("word"))
    done = among(done, written(open_.select("word").distinct(), "words"), ["word"])
    met = open_.join(done.hint("merge"), ["user_id", "word"]).where("done_ts > ts").groupBy("user_id", "capture_id", "what", "done_id", "done_ts").agg(F.count("*").alias("n")).where("n >= 2")
    return met.groupBy("user_id", "capture_id", "what").agg(F.min("done_ts").alias("closed_at"))


def labelled_numbers(captures: DataFrame, text: str = "body") -> DataFrame:
    """TXT-14: (capture_id, user_id, page_key, text, ts) to (capture_id, user_id, page_key, ts, at, label, value, unit): the first number of each personal measure in a text.

    Lines of 4 to 120 characters count; zeros, bare years and numbers of seven digits or more are no values.  Modifiers are dropped from labels.
    Only lines with a digit and the letters of some measure are looked through: no other can give a value.
    """
    some = F.filter(lines_of(text), lambda x: x.rlike("[0-9]") & x.rlike("(?i)" + "|".join(METRICS)))
    lines = F.filter(F.transform(some, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x).between(4, 120))
    own = ["capture_id", "user_id", "page_key", "ts"]
    s = captures.select(*own, F.posexplode(lines).alias("row", "line"))
    group = lambda k: F.regexp_extract_all("line", F.lit(PAIR), F.lit(k))
    s = s.select(*own, "row", F.posexplode(F.arrays_zip(group(1).alias("label"), group(2).alias("cur"), group(3).alias("num"), group(4).alias("unit"))).alias("m", "x")).select(*own, "row", "m", "x.*")
    s = s.withColumn("label", F.trim("label")).withColumn("value", F.replace("num", F.lit(","), F.lit("")).try_cast("double"))
    words = F.regexp_extract_all(F.lower("label"), F.lit("([a-z]+)"), F.lit(1))
    s = s.withColumn("core", F.filter(words, lambda w: ~w.isin(*MODIFIERS)))
    good = (F.length("label") >= 3) & ~F.col("label").rlike(SECRET_LABEL) & ~F.col("label").rlike(CHROME_LABEL) & ~F.col("label").rlike(JUNK_LABEL) & (F.size("core") > 0) & F.forall("core", lambda w: w.isin(*METRICS))
    long = F.length(F.regexp_replace("num", "[^0-9]", "")) >= 7
    year = ~F.col("num").contains(".") & F.col("value").between(1900, 2100)
    s = s.where(good & (F.col("value") != 0) & ~long & ~year).select(*own, "row", "m", F.left(F.concat_ws(" ", "core"), F.lit(40)).alias("label"), "value", F.coalesce(F.nullif("unit", F.lit("")), F.nullif("cur", F.lit("")), F.lit("")).alias("unit"))
    first = s.groupBy(*own, "label").agg(F.min(F.struct("row", "m", "value", "unit")).alias("x"))
    return first.select(*own, (F.col("x.row") * 1000 + F.col("x.m")).alias("at"), "label", "x.value", "x.unit")


def observations(found: DataFrame) -> DataFrame:
    """The first NUMBERS_A_CAPTURE numbers of each capture, without those of noisy pages and pages without a key."""
    rows = found.where(F.col("page_key").isNotNull() & (F.col("page_key") != "") & ~F.col("page_key").rlike(NOISE_KEY))
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("capture_id").orderBy("at"))).where(F.col("_place") <= NUMBERS_A_CAPTURE).drop("_place")


def stored_numbers(found: DataFrame) -> DataFrame:
    """STR-5, JN-21, WIN-8: a user's observations in the order of time, without those of another unit than the one most seen so far for their page and label,
    and without values stored within the day before.  The state of a (user, page, label) is its unit counts and the values of one day."""
    rows = observations(found).withColumn("_sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    return fold_rows(rows, ["user_id", "page_key", "label"], ["ts", "capture_id", "at"], ["value", "unit", "_sec"], lambda: ({}, {}), new_value).drop("_sec")


def new_value(state: tuple[dict, dict], row: tuple) -> bool:
    """Whether (value, unit, second) is stored; the state is the counts of units, and the values of one day with their second."""
    (units, recent), (value, unit, sec) = state, row
    settled = min(units, key=lambda u: (-units[u], u)) if units else ""
    if settled and unit and unit != settled:
        return False
    for v in [v for v, s in recent.items() if sec - s > 86400]:
        del recent[v]
    if value in recent:
        return False
    recent[value] = sec
    if unit:
        units[unit] = units.get(unit, 0) + 1
    return True


def _promised(spark, sf_dir, where: str = "true") -> DataFrame:
    """Commitments of the notes of some captures; texts are looked through once a document, and none meets a capture."""
    said = F.when(may_promise(F.col("ocr_text")), promising("ocr_text"))
    df = captures(spark, sf_dir, made={"said": said}).where(where).select("capture_id", "user_id", "ts", "app", "url", note_line().alias("line"), "said")
    return promised(df, of_notes("said"))


@query("commitments")
def commitments_q(spark, sf_dir) -> DataFrame:
    return _promised(spark, sf_dir)


#: What each planted line of the notes gives, as an authored surface: (who, what, confidence), or none.
_GIVES = {
    0: ("me", "I'll send the report to Dana by Friday", 0.95), 1: ("them", "please reply to the landlord by tomorrow", 0.85), 2: ("me", "I need to call the bank about the loan", 0.70), 3: ("me", "need to email the professor tonight", 0.85),
    4: ("me", "Submit the tax form this week", 0.75),
}


@query("commitments_stored", over_captures(
    "SELECT capture_id, who, what, due, confidence FROM (SELECT capture_id, ts, k, CASE k " + " ".join(f"WHEN {k} THEN '{w}'" for k, (w, _, _) in _GIVES.items()) + " END AS who, CASE k " + " ".join("WHEN {} THEN '{}'".format(k, x.replace("'", "''")) for k, (_, x, _) in _GIVES.items()) + " END AS what, "
    "CASE k WHEN 1 THEN ts::DATE + 1 WHEN 3 THEN ts::DATE WHEN 4 THEN ts::DATE + CAST((12 - isodow(ts)) % 7 AS INTEGER) END AS due, CASE k " + " ".join(f"WHEN {k} THEN {c}::DOUBLE" for k, (_, _, c) in _GIVES.items()) + f" END AS confidence FROM notes_v WHERE app IN ('Mail', 'Notes')) WHERE k < {len(_GIVES)}", NOTES_SQL))
def commitments_stored(spark, sf_dir) -> DataFrame:
    """TXT-12, WIN-7: what the notes' authored surfaces promise in their planted lines (their other text is made of invented words)."""
    found = _promised(spark, sf_dir, "app IN ('Mail', 'Notes')")
    return storable(found).select("capture_id", "who", "what", "due", "confidence")


@query("commitments_new")
def commitments_new(spark, sf_dir) -> DataFrame:
    """JN-10, STR-4 as a table job."""
    return new_commitments(storable(_promised(spark, sf_dir)))


@query("commitments_kept", over_captures(
    "SELECT m.user_id, m.capture_id, m.k, min(d.ts) AS closed_at FROM notes_v m JOIN notes_v d ON d.user_id = m.user_id AND d.k = 6 AND d.app IN ('Mail', 'Notes') AND d.ts > m.ts WHERE m.k = 0 AND m.app <> 'Terminal' GROUP BY 1, 2, 3", NOTES_SQL))
def commitments_kept(spark, sf_dir) -> DataFrame:
    """JN-11: the planted report is sent, and closed by the line that says so."""
    made = storable(_promised(spark, sf_dir)).where("what LIKE '%send the report%'")
    says = F.coalesce(F.col("says"), F.lit(False)) | note_line().contains(NOTE_LINES[6])
    some = captures(spark, sf_dir, made={"says": F.col("ocr_text").contains(NOTE_LINES[6])}).where(says & (source_class() == "authored"))
    closing = notes(spark, sf_dir, written(some.select("capture_id").distinct(), "closing")).where(F.col("body").contains(NOTE_LINES[6]))
    return kept_promises(made, closing).select("user_id", "capture_id", F.lit(0).cast("long").alias("k"), "closed_at")


@query("labelled_numbers", over_captures(
    "SELECT capture_id, CASE k WHEN 7 THEN 'weight' WHEN 8 THEN 'heart rate' WHEN 9 THEN 'score' WHEN 12 THEN 'steps' END AS label, CASE k WHEN 7 THEN round(60 + capture_id % 40 + 0.5, 1) WHEN 8 THEN CAST(50 + capture_id % 30 AS DOUBLE) WHEN 9 THEN CAST(1 + capture_id % 99 AS DOUBLE) WHEN 12 THEN CAST(1000 + capture_id % 800 AS DOUBLE) END AS value, "
    "CASE k WHEN 7 THEN 'kg' WHEN 9 THEN '%' ELSE '' END AS unit FROM notes_v WHERE k IN (7, 8, 9, 12)", NOTES_SQL))
def labelled_numbers_q(spark, sf_dir) -> DataFrame:
    """TXT-14 over the notes: three of their lines name a measure; the other numbers in them are none."""
    return labelled_numbers(notes(spark, sf_dir)).select("capture_id", "label", "value", "unit")


@query("numbers_stored")
def numbers_stored(spark, sf_dir) -> DataFrame:
    """STR-5 as a table job."""
    return stored_numbers(labelled_numbers(notes(spark, sf_dir)))
