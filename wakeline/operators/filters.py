"""Gates and filters over captures and the query log (column predicates only; nothing here shuffles but the counts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_app, page_key, tokens
from ..plans.catalog import over_captures, query
from ..sources.captures import captures, query_log

# Words, apps and patterns that decide the results.
SKIP_APPS = ("Dock", "Mission Control", "WindowManager", "Window Server")
PRIVATE_WORDS = ("incognito", "private browsing", "(private)")
KILL_APPS = ("Terminal",)
KILL_URLS = ("spam-farm",)
EXCLUDED_APPS = ("mail",)
EXCLUDED_SITES = ("cheap-pills.example.com", "example.net/fr")
MIN_CHARS = 40
AUTHORED_APPS = ("notes", "stickies", "textedit", "mail", "outlook", "spark", "mimestream", "slack", "discord", "telegram", "microsoft teams", "reminders", "things", "obsidian", "notion", "bear", "craft")
BLOCKED_APPS = ("antigravity ide", "claude", "gemini", "chatgpt", "cursor", "code", "visual studio code", "xcode", "terminal", "iterm2", "warp", "dock", "finder", "system settings", "activity monitor", "screen sharing", "zoom.us", "lockdown browser", "health")
BLOCKED_URL = r"(?i)(claude\.ai|chatgpt\.com|chat\.openai\.com|gemini\.google|perplexity\.ai|poe\.com|meta\.ai|copilot\.microsoft|youtube\.com|netflix\.com)"
AUTHORED_URL = r"(?i)(mail\.google\.com|gmail\.com|outlook\.(?:live|office)|slack\.com|discord\.com|web\.telegram\.org|teams\.(?:microsoft|live)|linkedin\.com/messaging|messenger\.com|web\.whatsapp)"
NOISE_KEY = r"(?i)(stream|torrent|soccer|/watch|youtube\.com|netflix|twitch|hulu|tiktok|instagram|reddit\.com|google\.com/search|bing\.com|duckduckgo|amazon\.|ebay\.|aliexpress|/opportunities|automatiq|outlier\.ai|claude\.ai|chatgpt\.com|chat\.openai|gemini\.google|perplexity|^(finder|dock|claude|gemini|chatgpt|antigravity ide|cursor|code|terminal|system settings)::)"
CATEGORIES = (
    ("name", r"\b(who|name|person|guy|girl|professor|recruiter|advisor|doctor|contact)\b"),
    ("date", r"\b(when|date|deadline|due|schedule|meeting)\b"),
    ("place", r"\b(where|place|restaurant|cafe|address|location|room|building)\b"),
    ("link", r"\b(link|url|site|website|repo|video|article|page|doc)\b"),
    ("number", r"[0-9]|how (much|many)|price|cost|amount|balance|number|total|phone|percent"),
)
UNPINNABLE = r"(?i)\b(today|yesterday|tonight|this (week|morning|afternoon|evening)|last (week|night)|now|currently|recently|what did i|what was i|what have i|summarize|recap|what changed|how has|what happened)\b"
ACTIVITY = r"(?i)\b(what (did|have) i (do|done|work(ed)? on)|what was i (doing|working on)|summarize|summary of|recap|what happened|how did i spend|what did i get done)\b"
STOP_WORDS = (
    "a", "an", "the", "i", "me", "my", "was", "is", "are", "were", "what", "which", "that", "this", "it", "of", "to", "in", "on", "at", "for", "from",
    "and", "or", "did", "do", "does", "have", "had", "has", "with", "about", "you", "can", "get", "find", "show", "tell", "there", "where", "when", "who", "how", "why",
    "right", "before", "after", "during", "some", "any", "again", "saw", "see", "looked", "looking", "open", "opened", "remember", "up", "past", "by",
)


def any_in(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def kill_reason(apps=KILL_APPS, urls=KILL_URLS) -> Column:
    """The first of app, url, private that blocks a capture; else null."""
    app = F.lower(clean_app()).isin([a.lower() for a in apps])
    url = any_in(F.lower(F.coalesce("url", F.lit(""))), urls)
    private = any_in(F.lower(F.coalesce("window_title", F.lit(""))), PRIVATE_WORDS)
    return F.when(app, "app").when(url, "url").when(private, "private")


def site_excluded(patterns=EXCLUDED_SITES) -> Column:
    """A pattern without a slash fits the host and its subdomains; with one, it is looked for in the whole address."""
    u = F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_extract(u, r"^[^:/?#]+://(?:[^/?#]*@)?([^/?#:]*)", 1)
    out = F.lit(False)
    for p in patterns:
        out = out | (F.contains(u, F.lit(p)) if "/" in p else (host == p) | F.endswith(host, F.lit("." + p)))
    return out


def gate_label() -> Column:
    """The gate's decision; the first that holds names it."""
    private = any_in(F.lower(F.coalesce("window_title", F.lit(""))), PRIVATE_WORDS)
    return (
        F.when(clean_app().isin(*SKIP_APPS), "pseudo")
        .when(F.lower(F.trim(clean_app())).isin(*EXCLUDED_APPS), "excluded_app")
        .when(F.lower(clean_app()).isin([a.lower() for a in KILL_APPS]), "kill_app")
        .when(private, "private")
        .when(any_in(F.lower(F.coalesce("url", F.lit(""))), KILL_URLS), "kill_url")
        .when(site_excluded(), "excluded_site")
        .otherwise("active")
    )


def source_class(app: str = "app", url: str = "url") -> Column:
    """How far to trust a surface: blocked, authored or strict."""
    a = F.lower(F.trim(F.coalesce(app, F.lit(""))))
    u = F.coalesce(url, F.lit(""))
    return F.when(a.isin(*BLOCKED_APPS), "blocked").when(a.isin(*AUTHORED_APPS), "authored").when(u.rlike(BLOCKED_URL), "blocked").when(u.rlike(AUTHORED_URL), "authored").otherwise("strict")


def question_category(text: str = "text") -> Column:
    out, t = F.lit("other"), F.lower(F.col(text))
    for name, pattern in reversed(CATEGORIES):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out


def content_words(text: str = "text") -> Column:
    return F.filter(tokens(text), lambda w: ~w.isin(*STOP_WORDS))


_HOST = "regexp_extract(lower(coalesce(url, '')), '^[^:/?#]+://(?:[^/?#]*@)?([^/?#:]*)', 1)"
_EXCLUDED = f"({_HOST} = 'cheap-pills.example.com' OR ends_with({_HOST}, '.cheap-pills.example.com') OR contains(lower(coalesce(url, '')), 'example.net/fr'))"
_PRIVATE = "(contains(lower(window_title), 'incognito') OR contains(lower(window_title), 'private browsing') OR contains(lower(window_title), '(private)'))"


@query("scan_window", over_captures("SELECT capture_id, user_id, ts, app, left(ocr_text, 600) AS head FROM captures_v WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12'"))
def scan_window(spark, sf_dir) -> DataFrame:
    """SRC-1, FLT-9: projected columns of an inclusive time window."""
    return captures(spark, sf_dir, text=True).where("ts >= timestamp_ntz'2024-01-05' AND ts <= timestamp_ntz'2024-01-12'").select("capture_id", "user_id", "ts", "app", F.substring("ocr_text", 1, 600).alias("head"))


@query("kill_list", over_captures(f"SELECT capture_id, CASE WHEN lower(app) = 'terminal' THEN 'app' WHEN contains(lower(coalesce(url, '')), 'spam-farm') THEN 'url' WHEN {_PRIVATE} THEN 'private' END AS reason FROM captures_v"))
def kill_list(spark, sf_dir) -> DataFrame:
    """FLT-1."""
    return captures(spark, sf_dir).select("capture_id", kill_reason().alias("reason"))


@query("excluded_apps", over_captures("SELECT capture_id, app FROM captures_v WHERE lower(trim(app)) NOT IN ('mail')"))
def excluded_apps(spark, sf_dir) -> DataFrame:
    """FLT-2."""
    return captures(spark, sf_dir).where(~F.lower(F.trim(clean_app())).isin(*EXCLUDED_APPS)).select("capture_id", "app")


@query("excluded_sites", over_captures(f"SELECT capture_id, url, {_EXCLUDED} AS excluded FROM captures_v WHERE url IS NOT NULL"))
def excluded_sites(spark, sf_dir) -> DataFrame:
    """FLT-3."""
    return captures(spark, sf_dir).where("url IS NOT NULL").select("capture_id", "url", site_excluded().alias("excluded"))


@query("enough_text", over_captures("SELECT capture_id FROM captures_v WHERE app NOT IN ('Dock', 'Mission Control', 'WindowManager', 'Window Server') AND length(trim(ocr_text)) >= 40"))
def enough_text(spark, sf_dir) -> DataFrame:
    """FLT-4."""
    return captures(spark, sf_dir, text=True).where(~F.col("app").isin(*SKIP_APPS) & (F.length(F.trim("ocr_text")) >= MIN_CHARS)).select("capture_id")


@query("gate_by_day", over_captures(f"SELECT CAST(ts AS DATE) AS day, CASE WHEN lower(app) = 'mail' THEN 'excluded_app' WHEN lower(app) = 'terminal' THEN 'kill_app' WHEN {_PRIVATE} THEN 'private' WHEN contains(lower(coalesce(url, '')), 'spam-farm') THEN 'kill_url' WHEN {_EXCLUDED} THEN 'excluded_site' ELSE 'active' END AS label, count(*) AS n FROM captures_v GROUP BY 1, 2"))
def gate_by_day(spark, sf_dir) -> DataFrame:
    """FLT-5, FLT-6: decisions of the gate, counted per label and day."""
    return captures(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), gate_label().alias("label")).agg(F.count("*").alias("n"))


@query("page_keys", over_captures("SELECT capture_id, page_key FROM keyed"))
def page_keys(spark, sf_dir) -> DataFrame:
    """FLT-7."""
    return captures(spark, sf_dir).select("capture_id", page_key().alias("page_key"))


@query("trust_class", over_captures("SELECT capture_id, CASE WHEN app = 'Terminal' THEN 'blocked' WHEN app IN ('Mail', 'Notes') THEN 'authored' ELSE 'strict' END AS trust FROM captures_v"))
def trust_class(spark, sf_dir) -> DataFrame:
    """FLT-10."""
    return captures(spark, sf_dir).select("capture_id", source_class().alias("trust"))


@query("number_pages", over_captures("SELECT capture_id, page_key FROM keyed WHERE NOT regexp_matches(page_key, '" + NOISE_KEY + "')"))
def number_pages(spark, sf_dir) -> DataFrame:
    """FLT-11: captures on pages where numbers are tracked."""
    return captures(spark, sf_dir, keyed=True).where(~F.col("page_key").rlike(NOISE_KEY)).select("capture_id", "page_key")


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in CATEGORIES) + " ELSE 'other' END"


@query("question_profile", over_captures(
    f"SELECT query_id, {_CATEGORY} AS category, regexp_matches(text, '{ACTIVITY}') AS is_activity, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains([{', '.join(repr(w) for w in STOP_WORDS)}], w))) = 0 AS is_generic, "
    f"NOT regexp_matches(text, '{UNPINNABLE}') AS pinnable, len(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda w: w <> '')) BETWEEN 3 AND 14 AND NOT regexp_matches(lower(text), '^(test|asdf|http)') AS suggestable FROM queries_v"
))
def question_profile(spark, sf_dir) -> DataFrame:
    """FLT-12 to 15: category, activity questions, pinnable, worth suggesting."""
    words = F.size(F.filter(F.split("text", r"[ \n\t\r]+"), lambda w: w != ""))
    return query_log(spark, sf_dir).select(
        "query_id", question_category().alias("category"), F.col("text").rlike(ACTIVITY).alias("is_activity"), (F.size(content_words()) == 0).alias("is_generic"),
        (~F.col("text").rlike(UNPINNABLE)).alias("pinnable"), (words.between(3, 14) & ~F.lower("text").rlike("^(test|asdf|http)")).alias("suggestable"),
    )
