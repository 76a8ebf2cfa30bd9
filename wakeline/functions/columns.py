"""Column functions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_app(app: str | Column = "app") -> Column:
    """An app name without invisible formatting characters."""
    return F.regexp_replace(col(app), "[\\u200B-\\u200F\\uFEFF]", "")


def normal_title(title: str | Column = "window_title") -> Column:
    """A title without a trailing or leading counter, in lower case with single blanks."""
    t = F.regexp_replace(F.trim(F.coalesce(col(title), F.lit(""))), r"\s*[\(\[]\s*\d+\s*[\)\]]\s*$", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"^\s*[\(\[]?\d+[\)\]]?\s+", ""), r"\s+", " ")))


def page_key(app: str = "app", title: str = "window_title", url: str = "url") -> Column:
    """Stable identity of a page: scheme://host/path in lower case for web pages, else app::title without counters."""
    u = F.trim(F.col(url))
    web = u.rlike(r"^(?i)https?://[^/?#]+")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:]+://[^/?#]+([^?#]*)", 1), r"/+$", "")
    key = F.concat(F.lower(F.regexp_extract(u, r"^([^:]+://[^/?#]+)", 1)), F.when(path == "", "/").otherwise(F.lower(path)))
    name, app_name = normal_title(title), F.lower(F.trim(F.coalesce(F.col(app), F.lit(""))))
    return F.when(web, key).otherwise(F.when(name == "", app_name).otherwise(F.concat(app_name, F.lit("::"), name)))


def host_of(url: str | Column = "url") -> Column:
    """Bare host: no credentials, port or leading www.; null for a null url."""
    h = F.lower(F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(h, r"^www\.", "")


def tokens(text: str | Column, least: int = 1) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(f"([a-z0-9]{{{least},}})"), F.lit(1))


def dot(a: str, b: str) -> Column:
    """Inner product of two float arrays in double precision."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)")


def recall_probability(days: Column, half_life: Column, decay: Column) -> Column:
    """(1 + f * t / h) ** d with f such that the curve is one half at t = h."""
    d = F.least(F.greatest(decay, F.lit(-0.8)), F.lit(-0.2))
    f = F.pow(F.lit(0.5), F.lit(1.0) / d) - 1
    return F.pow(1 + f * (F.greatest(days, F.lit(0.0)) / F.greatest(half_life, F.lit(0.1))), d)
