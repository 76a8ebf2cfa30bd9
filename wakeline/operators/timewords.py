"""Time phrases of questions: what span of time a question speaks of, and the question without that phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import over_captures, query
from ..sources.captures import captures, query_log

# The words that name times, and the hours of the parts of a day.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
DAY_PARTS = {"morning": (5, 12), "afternoon": (12, 17), "evening": (17, 21), "night": (21, 24)}
PART = r"\b(morning|afternoon|evening|night)\b"
AMOUNT = r"\b(?:last|past|previous)\s+(\d+|an?|a?\s*few|a?\s*couple(?:\s+of)?)\s+(hour|hr|minute|min|day|week)s?\b"
NAMED_DAY = r"\b(last|this|on)?\s*(" + "|".join(WEEKDAYS) + r")\b"
WEEKEND = r"\b(?:this\s+|last\s+|over\s+the\s+|on\s+the\s+|the\s+)?weekend\b"


#: Days back that are within the calendar.
MOST_DAYS = 700_000
#: Time phrases in the order in which they are looked for: a name, the pattern, and what is taken out of the question.
RULES = (
    ("today", r"\btoday\b", r"\btoday\b|\b(?:this\s+)?(?:morning|afternoon|evening|night)\b"),
    ("yesterday", r"\byesterday\b", r"\byesterday\b|" + PART),
    ("ago", r"\b(\d+)\s+days?\s+ago\b", r"\b\d+\s+days?\s+ago\b|" + PART),
    ("weekday", NAMED_DAY, NAMED_DAY + "|" + PART),
    ("last week", r"\blast\s+week\b", r"\blast\s+week\b"),
    ("this week", r"\bthis\s+week\b", r"\bthis\s+week\b"),
    ("this part", r"(?s)^(?=.*\b(?:morning|afternoon|evening|night)\b).*\bthis\b", r"\bthis\s+(?:morning|afternoon|evening|night)\b"),
    ("amount", AMOUNT, AMOUNT),
    ("hour", r"\b(?:past|last|this)\s+hour\b", r"\b(?:past|last|this)\s+hour\b"),
    ("past week", r"\bpast\s+week\b", r"\bpast\s+week\b"),
    ("this month", r"\bthis\s+month\b", r"\bthis\s+month\b"),
    ("last month", r"\b(?:last|past)\s+month\b", r"\b(?:last|past)\s+month\b"),
    ("weekend", r"\bweekend\b", WEEKEND),
    ("tonight", r"\btonight\b", r"\btonight\b"),
    ("last night", r"\blast\s+night\b", r"\blast\s+night\b"),
)


def with_window(questions: DataFrame, zone: str | Column = "UTC") -> DataFrame:
    """TXT-24: questions (question, ts, ...) with since, until and rest: the span that the first time phrase names, seen from ts.

    ts, since and until are UTC (timestamp_ntz); days begin at midnight of zone, a name or a column of names.  Either end may be null: no bound.
    A span of more than MOST_DAYS days has no beginning, nor has a day longer ago than that an end.
    rest is the question without the phrase and with single blanks; without a phrase the question as it is.  A null question has no span.
    A query_id stands for one question.
    """
    tz = zone if isinstance(zone, Column) else F.lit(zone)
    q, now, today, weekday, part = (F.col(c) for c in ("_q", "_now", "_today", "_weekday", "_part"))
    which = F.lit(None).cast("string")
    for name, pattern, _ in reversed(RULES):
        which = F.when(q.rlike(pattern), name).otherwise(which)
    df = questions.withColumns({"_q": F.lower("question"), "_now": F.convert_timezone(F.lit("UTC"), tz, F.col("ts"))})
    df = df.withColumns({"_rule": which, "_today": F.date_trunc("day", now).cast("timestamp_ntz"), "_weekday": F.weekday(now), "_part": F.regexp_extract(q, PART, 1)})
    first, last = F.lit(0), F.lit(24)
    for name, (a, b) in DAY_PARTS.items():
        first, last = F.when(part == name, a).otherwise(first), F.when(part == name, b).otherwise(last)
    target = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.regexp_extract(q, NAMED_DAY, 2)).cast("int") - 1
    since_day = F.pmod(weekday - target, F.lit(7))
    since_day = F.when((since_day == 0) & (F.regexp_extract(q, NAMED_DAY, 1) == "last"), 7).otherwise(since_day)
    ago = F.regexp_extract(q, r"\b(\d+)\s+days?\s+ago\b", 1).try_cast("int")
    ago = F.when(ago <= MOST_DAYS, ago)
    word, unit = F.regexp_replace(F.regexp_extract(q, AMOUNT, 1), r"\s+", " "), F.regexp_extract(q, AMOUNT, 2)
    n = F.when(word.contains("few"), 3).when(word.contains("couple"), 2).when(word.rlike("^[0-9]+$"), word.try_cast("long")).otherwise(1)
    each = F.when(unit.isin("hour", "hr"), 3600).when(unit.isin("minute", "min"), 60).when(unit == "day", 86400).otherwise(604800)
    rule = F.col("_rule")
    back = F.when(rule == "yesterday", 1).when(rule == "ago", ago).when(rule == "weekday", since_day).otherwise(0)
    saturday = -F.pmod(weekday - 5, F.lit(7)) - F.when(q.rlike(r"\blast\s+weekend\b"), 7).otherwise(0)
    df = df.withColumns({"_back": -back, "_first": first * 3600, "_last": F.when(last == 24, 86399).otherwise(last * 3600), "_span": -F.when(F.try_multiply(n, each.cast("long")) <= MOST_DAYS * 86400, F.try_multiply(n, each.cast("long"))), "_saturday": saturday})
    # (days, seconds) from the start of the day, the month or from now, for both ends
    day, sat, span = F.col("_back"), F.col("_saturday"), F.col("_span")
    ends = {
        "last week": (-weekday - 7, 0, -weekday - 1, 86340), "this week": (-weekday, 0, 0, 0), "amount": (0, span, 0, 0), "hour": (0, -3600, 0, 0), "past week": (-7, 0, 0, 0), "this month": (0, 0, 0, 0), "last month": (0, 0, 0, -1),
        "weekend": (sat, 0, sat + 1, 86399), "tonight": (0, 61200, 0, 86399), "last night": (-1, 64800, 0, 21600),
    }
    parts = [day, F.col("_first"), day, F.col("_last")]
    for name, values in ends.items():
        parts = [F.when(rule == name, x).otherwise(p) for x, p in zip(values, parts, strict=True)]
    month = F.date_trunc("month", now).cast("timestamp_ntz")
    base = F.when(rule.isin("amount", "hour", "past week"), now).when(rule.isin("this month", "last month"), month).when(rule.isNotNull(), today)
    taken = F.lit(None).cast("string")
    for name, _, phrase in RULES:
        taken = F.when(rule == name, "(?i)" + phrase).otherwise(taken)
    df = df.withColumns({"_base": base, "_taken": taken, **{f"_p{k}": p for k, p in enumerate(parts)}})
    from_ = F.when(rule == "last month", F.add_months(F.col("_base").cast("date"), -1).cast("timestamp_ntz")).otherwise(F.col("_base"))
    at = lambda t, days, secs: F.convert_timezone(tz, F.lit("UTC"), t + F.make_dt_interval(days=F.col(days), secs=F.col(secs)))
    until = F.when(~rule.isin("this week", "this month"), at(F.col("_base"), "_p2", "_p3"))
    rest = F.when(rule.isNull(), F.col("question")).otherwise(F.trim(F.regexp_replace(F.regexp_replace("question", F.col("_taken"), F.lit(" ")), r"\s+", " ")))
    out = F.struct(*questions.columns, at(from_, "_p0", "_p1").alias("since"), until.alias("until"), rest.alias("rest"))
    # the aggregate keeps later filters on the span from being pushed into these expressions again and again
    return df.groupBy("query_id").agg(F.first(out).alias("_x")).select("_x.*")


#: Phrases that the fixture's questions end with, one after the other, and their spans in SQL (d: the day's midnight, t: the time asked).
PHRASES = (
    ("today", "d", "d + INTERVAL 86399 SECOND"), ("yesterday morning", "d - INTERVAL 19 HOUR", "d - INTERVAL 12 HOUR"), ("3 days ago", "d - INTERVAL 3 DAY", "d - INTERVAL 172801 SECOND"),
    ("last friday", "d - to_days(CASE WHEN isodow(d) = 5 THEN 7 ELSE CAST((isodow(d) + 2) % 7 AS INTEGER) END)", "d - to_days(CASE WHEN isodow(d) = 5 THEN 7 ELSE CAST((isodow(d) + 2) % 7 AS INTEGER) END) + INTERVAL 86399 SECOND"),
    ("on monday evening", "d - to_days(CAST(isodow(d) - 1 AS INTEGER)) + INTERVAL 17 HOUR", "d - to_days(CAST(isodow(d) - 1 AS INTEGER)) + INTERVAL 21 HOUR"),
    ("last week", "d - to_days(CAST(isodow(d) + 6 AS INTEGER))", "d - to_days(CAST(isodow(d) - 1 AS INTEGER)) - INTERVAL 1 MINUTE"), ("this week", "d - to_days(CAST(isodow(d) - 1 AS INTEGER))", "NULL"),
    ("this afternoon", "d + INTERVAL 12 HOUR", "d + INTERVAL 17 HOUR"), ("in the past 3 days", "t - INTERVAL 3 DAY", "t"), ("in the last couple of weeks", "t - INTERVAL 14 DAY", "t"), ("past 90 minutes", "t - INTERVAL 90 MINUTE", "t"),
    ("this hour", "t - INTERVAL 1 HOUR", "t"), ("past week", "t - INTERVAL 7 DAY", "t"), ("this month", "date_trunc('month', d)", "NULL"), ("last month", "date_trunc('month', d) - INTERVAL 1 MONTH", "date_trunc('month', d) - INTERVAL 1 SECOND"),
    ("over the weekend", "d - to_days(CAST((isodow(d) + 1) % 7 AS INTEGER))", "d - to_days(CAST((isodow(d) + 1) % 7 AS INTEGER)) + INTERVAL 172799 SECOND"), ("tonight", "d + INTERVAL 17 HOUR", "d + INTERVAL 86399 SECOND"), ("last night", "d - INTERVAL 6 HOUR", "d + INTERVAL 6 HOUR"), ("", "NULL", "NULL"),
)
_KIND = f"query_id % {len(PHRASES)}"
_CASE = lambda k: "CASE " + _KIND + " " + " ".join(f"WHEN {i} THEN {p[k]}" for i, p in enumerate(PHRASES)) + " END"
#: The question log with a time phrase behind each question, and the span it names.
# "this" anywhere makes the night of "last night" this one, and then the phrase stays in the question
_NIGHT = f"{_KIND} = 17 AND regexp_matches(lower(text), '\\bthis\\b')"
WINDOWS_SQL = (
    f"asked_v AS (SELECT query_id, user_id, text, ts, embedding, CASE WHEN {_NIGHT} THEN d + INTERVAL 21 HOUR ELSE CAST({_CASE(1)} AS TIMESTAMP) END AS since, CASE WHEN {_NIGHT} THEN d + INTERVAL 86399 SECOND ELSE CAST({_CASE(2)} AS TIMESTAMP) END AS until, "
    f"CASE WHEN {_NIGHT} THEN trim(regexp_replace(text || ' last night', '\\s+', ' ', 'g')) WHEN {_KIND} = {len(PHRASES) - 1} THEN text || ' ' ELSE trim(regexp_replace(text || CASE WHEN {_KIND} = 8 THEN ' in the' WHEN {_KIND} = 9 THEN ' in the' ELSE '' END, '\\s+', ' ', 'g')) END AS rest FROM (SELECT *, ts AS t, date_trunc('day', ts)::TIMESTAMP AS d FROM queries_v))"
)


def asked(spark, sf_dir) -> DataFrame:
    """The question log, each question with a time phrase behind it: (query_id, user_id, question, text, ts, embedding)."""
    phrase = F.element_at(F.array(*(F.lit(p[0]) for p in PHRASES)), (F.col("query_id") % len(PHRASES) + 1).cast("int"))
    return query_log(spark, sf_dir).withColumn("question", F.concat_ws(" ", "text", phrase))


@query("time_windows", over_captures("SELECT query_id, since, until, rest FROM asked_v", WINDOWS_SQL))
def time_windows(spark, sf_dir) -> DataFrame:
    """TXT-24 over the question log."""
    return with_window(asked(spark, sf_dir)).select("query_id", "since", "until", "rest")


def in_windows(questions: DataFrame, df: DataFrame) -> DataFrame:
    """JN-12: df's rows of a question's user inside its span; both sides are dealt by user and day where the span is bounded on both ends.

    questions need query_id, user_id, since and until; either end may be null.  Spans without a beginning or an end meet the user's rows at large.
    """
    day = lambda c: F.unix_date(F.to_date(c))
    q = questions.select("query_id", "user_id", "since", "until")
    both = F.col("since").isNotNull() & F.col("until").isNotNull()
    bounded = q.where(both & (F.col("since") <= F.col("until"))).withColumn("bucket", F.explode(F.sequence(day("since"), day("until"))))
    near = df.withColumn("bucket", day("ts")).join(bounded.hint("merge"), ["user_id", "bucket"]).where("ts BETWEEN since AND until").drop("bucket")
    open_ = df.join(q.where(~both).hint("merge"), "user_id").where("(since IS NULL OR ts >= since) AND (until IS NULL OR ts <= until)")
    return near.unionByName(open_)


@query("asked_captures", over_captures("SELECT query_id, count(*) AS n, min(capture_id) AS first_id, max(capture_id) AS last_id FROM asked_v q JOIN captures_v c USING (user_id) WHERE (since IS NULL OR c.ts >= since) AND (until IS NULL OR c.ts <= until) GROUP BY 1", WINDOWS_SQL))
def asked_captures(spark, sf_dir) -> DataFrame:
    """JN-12 over the spans that the questions name."""
    near = in_windows(with_window(asked(spark, sf_dir)), captures(spark, sf_dir).select("user_id", "capture_id", "ts"))
    return near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("capture_id").alias("first_id"), F.max("capture_id").alias("last_id"))
