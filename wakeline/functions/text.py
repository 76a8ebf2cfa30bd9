"""Text functions of captures and documents: column to column, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

# Labels and patterns that decide the results.
CREDENTIALS = (
    ("SSN-like number", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("card-like number", r"\b(?:\d[ -]?){15,16}\b"),
    ("password assignment", r"(?i)\bpassword\s*[:=]\s*\S+"),
    ("API key", r"(?i)\bapi[_ -]?key\s*[:=]\s*\S+"),
)
CHURN = (r"^\d{1,2}:\d{2}(:\d{2})?\s*(am|pm)?$", r"^\d{1,3}%$", r"^[•·]?\s*\d+\s*(views?|comments?|likes?|new|unread|notifications?)$", r"^\(\d+\)$", r"^\d{1,2}/\d{1,2}/\d{2,4}$", r"^page \d+ of \d+$")
CHROME_WORDS = (
    "file edit view tabs tab bookmarks bookmark history extensions extension window help format selection develop favorites menu toolbar profiles "
    "run go terminal dock mon tue wed thu fri sat sun jan feb mar apr may jun jul aug sep oct nov dec"
).split()
MENU_BAR = r"(?i)^.{0,90}?\bHelp\b\s*"
JUNK_HEAD = r"(?i)^(?:(?:\d[\d,.:%]*|[•·|@&()\[\]<>/\\+*=~^_-]+|[a-z]|am|pm|mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?: |$))+"
LINK = r"https?://[^\s)]+"
NUMBER = r"[$€£]?\d[\d,]*\.?\d*%?"
QUOTE = r"(?i)^\s*(?:>+|\|)\s|^\s*On\b.{0,80}\bwrote:\s*$|^\s*(?:From|Sent|To|Cc|Bcc|Subject|Date|Reply-To):\s"
SIGNATURE = r"(?i)^\s*(?:--\s*$|—\s*\w|sent from my \w.*|get outlook for .*|(?:best(?: regards)?|kind regards|regards|cheers|thanks(?:,| again)?|sincerely|warmly|yours truly)\s*[,.]?\s*$)"
DISCLAIMER = r"(?i)confidential|do not (?:reply|forward|distribute)|unsubscribe|privacy policy|all rights reserved|©|\(c\)\s*\d{4}|terms of service"
SENTENCE_END = r"[.?!\n]|\s{2,}|\s+[-–—•|›]\s+"
STACK_TRACE = r"(?i)traceback|exception|error:|stack trace|\bat [\w.$]+\("
MEETING = r"(?i)\b(zoom|google meet|meet\.google|teams|webex|join now|meeting)\b"
THREAD_STOP_WORDS = (
    "a an the and or but of to in on at for from with without by as is are was were be been being it its this that these those there here he she they them his her their "
    "you your i my me we our not no still yet only just any some over into out up down about after before during while than then so if when what which who whom whose "
    "had has have do does did done get got make made take taken go goes went"
).split()
CARD = r"(?<![\w-])(?:\d[ -]?){12,18}\d(?![\w-])"
SSN = r"(?<!\d)(?!000|666|9)(\d{3})-(?!00)(\d{2})-(?!0000)(\d{4})(?!\d)"


def credential(text: str | Column = "text") -> Column:
    """TXT-2: the first kind of secret that a text holds; null without one."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(CREDENTIALS):
        out = F.when(col(text).rlike(pattern), label).otherwise(out)
    return out


def redact(text: str = "text") -> Column:
    """TXT-1: card numbers (13 to 19 digits, first digit 3 to 6, right check digit) and issued social security numbers masked.

    Running it again changes nothing; a null text stays null.  A longer candidate is masked before one that is a part of it.
    """
    cards = F.filter(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"({CARD})"), F.lit(1))), lambda c: F.regexp_replace(c, "[ -]", "").rlike("^[3-6]") & F.call_function("luhn_check", F.regexp_replace(c, "[ -]", "")))
    by_length = F.array_sort(cards, lambda a, b: F.length(b) - F.length(a))
    return F.regexp_replace(F.aggregate(by_length, F.col(text), lambda t, c: F.replace(t, c, F.lit("[card]"))), SSN, "[ssn]")


def collapse_doubled(text: str = "text") -> Column:
    """TXT-3: a word that comes again at once, in any case, is kept once; numbers are left alone."""
    return F.regexp_replace(F.col(text), r"(?i)\b([A-Za-z]{2,})(?:\s+\1\b)+", "$1")


def words_of(text: str | Column) -> Column:
    return F.filter(F.split(col(text), r"[ \t\r\n\f]+"), lambda w: w != "")


def lines_of(text: str | Column) -> Column:
    return F.split(col(text), "\n")


def doubled_words(text: str = "text") -> Column:
    """TXT-4: words equal to the one before them in the same line."""
    in_line = lambda line: F.size(F.filter(F.zip_with(words_of(line), F.slice(F.concat(F.array(F.lit("")), words_of(line)), 1, F.greatest(F.size(words_of(line)), F.lit(1))), lambda a, b: a == b), lambda x: x))
    return F.aggregate(F.transform(lines_of(text), in_line), F.lit(0), lambda s, n: s + n).cast("long")


def overlap(a: str, b: str) -> Column:
    """TXT-5: Jaccard similarity of two word sets in lower case; 1 where both are empty."""
    x, y = words_of(F.lower(F.col(a))), words_of(F.lower(F.col(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def meaningful(line: Column) -> Column:
    """TXT-6: a line that is long enough, no counter or clock, and no menu bar."""
    keep = F.length(line) >= 3
    for pattern in CHURN:
        keep = keep & ~line.rlike("(?i)" + pattern)
    return keep & (F.size(F.filter(F.regexp_extract_all(F.lower(line), F.lit("([a-z]+)"), F.lit(1)), lambda w: w.isin(*CHROME_WORDS))) < 3)


def clean_lines(text: str = "text") -> Column:
    return F.filter(F.transform(lines_of(text), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " "))), meaningful)


def snippet(text: str = "text", n: int = 120) -> Column:
    """TXT-7: the head of a text behind its menu bar, clock and battery."""
    t = F.trim(F.regexp_replace(F.col(text), r"[ \t\r\n\f]+", " "))
    return F.trim(F.substring(F.regexp_replace(F.regexp_replace(t, MENU_BAR, ""), JUNK_HEAD, ""), 1, n))


def all_found(text: str, pattern: str) -> Column:
    """The distinct matches of a pattern, in order."""
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1)))


def first_found(text: str, pattern: str, most: int) -> Column:
    """TXT-9: the first distinct matches of a pattern, in order."""
    return F.slice(all_found(text, pattern), 1, most)


def body(text: str = "text") -> Column:
    """TXT-10: a message without quoted lines, headers, signatures and disclaimers."""
    return F.array_join(F.filter(lines_of(text), lambda x: ~(x.rlike(QUOTE) | x.rlike(SIGNATURE) | x.rlike(DISCLAIMER))), "\n")


def sentences(text: str = "text") -> Column:
    """TXT-11: pieces of 8 to 200 characters with three words or more."""
    words = lambda s: F.size(F.regexp_extract_all(s, F.lit("([A-Za-z]{2,})"), F.lit(1)))
    return F.filter(F.transform(F.split(F.col(text), SENTENCE_END), lambda s: F.trim(s)), lambda s: F.length(s).between(8, 200) & (words(s) >= 3))


def stem(word: Column) -> Column:
    w = F.when(F.startswith(word, F.lit("un")) & (F.length(word) >= 6), F.substr(word, F.lit(3))).otherwise(word)
    cut = lambda n: F.substr(w, F.lit(1), F.length(w) - n)
    return F.when(w.rlike("^.{4,}ing$"), cut(3)).when(w.rlike("^.{4,}ed$"), cut(2)).when(w.rlike("^.{4,}es$"), cut(2)).when(w.rlike("^.{4,}s$") & ~w.rlike("ss$"), cut(1)).otherwise(w)


def content_stems(text: str = "text") -> Column:
    """TXT-19: sorted distinct stems of the content words."""
    found = F.regexp_extract_all(F.regexp_replace(F.lower(F.col(text)), "[*_`]+", ""), F.lit("([a-z0-9]{3,})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda w: ~w.isin(*THREAD_STOP_WORDS)), stem)))


def day_phrase(ts: str, as_of: str) -> Column:
    """TXT-20: a day told relative to another."""
    days = F.datediff(F.lit(as_of).cast("date"), F.to_date(ts))
    return F.when(days <= 0, "earlier today").when(days == 1, "yesterday").when(days < 7, F.concat(F.lit("on "), F.date_format(ts, "EEEE"))).otherwise(F.concat(F.lit("on "), F.date_format(ts, "MMM d")))


def trigrams(text: str = "text") -> Column:
    """TXT-23: distinct trigrams of the first twelve words of three letters or more."""
    words = F.slice(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9]{3,})"), F.lit(1)), 1, 12)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def owner(path: str = "path") -> Column:
    """TXT-27: the first folder of a path in lower case; null at the top level."""
    parts = F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/")
    return F.when((F.size(parts) > 1) & (parts[0] != ""), F.lower(parts[0]))
