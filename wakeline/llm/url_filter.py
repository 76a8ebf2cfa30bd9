"""Operator 10, URL filters: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

The vocabulary is a table (term, strict) of the caller's; STRICT_TERMS and SOFT_TERMS are the one of the registered query.  Terms are lower-cased (A-Z) and
each counts once, strict if any of its rows is; null and empty terms go.  It is read to the driver, made into one automaton and broadcast, up to
VOCABULARY_ROWS terms; a longer one is refused.

A term counts only where no letter or digit (a-z, 0-9) stands directly before or after it in the lower-cased url.  One strict
term rejects a url; soft terms reject it when at least SOFT_HITS distinct ones occur.

A null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by its terms alone (a null has none:
allowed).  Urls of any length are judged whole, repeated rows alike; of rules of equal length the last in order wins.  Extra columns pass through, but those
named like a column of the result are replaced by it; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table

#: (verdict, host, path): a rule fits its host and all subdomains when the url's path starts with its path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Vocabulary: terms and whether one alone rejects.
STRICT_TERMS = ("casino", "porn", "xxx", "viagra", "malware", "phishing", "spam", "adult")
SOFT_TERMS = ("bets", "bet", "free", "cheap", "pills", "win", "ads", "track", "farm", "poker", "loan", "click", "bonus", "prize", "hot", "deal")
SOFT_HITS = 2
VOCABULARY_ROWS = 1_000_000


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path of a url column."""
    at = F.instr(url, "://")
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.when(at > 0, host).otherwise("")).withColumn("path", F.when(at > 0, path).otherwise(""))


def with_rule(df: DataFrame, rules: tuple = RULES) -> DataFrame:
    """df (host, path) with the longest rule that fits, and that rule's verdict (both null where none does)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def automaton_of(terms: list[tuple[str, bool]]) -> ahocorasick.Automaton | None:
    """An automaton of terms, or None without any: an automaton without words can't be searched."""
    weights: dict[str, bool] = {}
    for term, strict in terms:
        if term:
            term = "".join(c.lower() if c.isascii() else c for c in term)
            weights[term] = bool(strict) or weights.get(term, False)
    if not weights:
        return None
    a = ahocorasick.Automaton()
    for term, strict in weights.items():
        a.add_word(term, (term, strict))
    a.make_automaton()
    return a


def vocabulary_terms(vocabulary: DataFrame | None) -> list[tuple[str, bool]]:
    """(term, strict) of a vocabulary table, or of the module's own."""
    if vocabulary is None:
        return [*((t, True) for t in STRICT_TERMS), *((t, False) for t in SOFT_TERMS)]
    rows = vocabulary.select("term", "strict").where("term IS NOT NULL").limit(VOCABULARY_ROWS + 1).collect()
    if len(rows) > VOCABULARY_ROWS:
        raise ValueError(f"the vocabulary has more than {VOCABULARY_ROWS} rows")
    return [(r.term, r.strict) for r in rows]


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def term_hits(automaton: ahocorasick.Automaton | None, url: str | None) -> tuple[int, int, int]:
    """Strict hits, soft hits, distinct soft terms of a url."""
    if automaton is None:
        return 0, 0, 0
    text = "".join(c.lower() if c.isascii() else c for c in url or "")
    strict, soft, distinct = 0, 0, set()
    for end, (term, is_strict) in automaton.iter(text):
        begin = end - len(term) + 1
        if (begin and _plain(text[begin - 1])) or (end + 1 < len(text) and _plain(text[end + 1])):
            continue
        strict += is_strict
        if not is_strict:
            soft += 1
            distinct.add(term)
    return strict, soft, len(distinct)


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            hits = [term_hits(automaton, u) for u in batch.column(0).to_pylist()]
            cols = [pa.array([h[k] for h in hits], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "strict_hits", "soft_hits", "soft_terms"])

    return run


def judge_urls(pages: DataFrame, rules: tuple = RULES, vocabulary: DataFrame | None = None, enough: int = SOFT_HITS) -> DataFrame:
    """pages (page_id, url, ...) with host, path, rule, strict_hits, soft_hits, soft_terms and verdict (allow or block).

    One strict term of the vocabulary (term, strict) blocks a url that no rule judges, and so do ``enough`` distinct soft ones.
    """
    shared = pages.sparkSession.sparkContext.broadcast(automaton_of(vocabulary_terms(vocabulary)))
    extra = [c for c in pages.columns if c not in ("url", "host", "path", "rule", "verdict", "rule_verdict", "strict_hits", "soft_hits", "soft_terms")]
    slim = pages.select("url", *extra)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    counted = slim.mapInArrow(_count(shared), f"{types}, strict_hits int, soft_hits int, soft_terms int")
    judged = with_rule(with_host_path(counted), rules)
    method = F.when((F.col("strict_hits") > 0) | (F.col("soft_terms") >= enough), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("rule_verdict", method)).drop("rule_verdict")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_terms")


def _terms_sql() -> str:
    find = "len(regexp_extract_all(regexp_replace(u, '([^a-z0-9])', '\\1\\1', 'g'), '(?:^|[^a-z0-9]){t}(?:[^a-z0-9]|$)'))"
    strict = " + ".join(find.format(t=t) for t in STRICT_TERMS)
    soft = " + ".join(find.format(t=t) for t in SOFT_TERMS)
    distinct = " + ".join(f"CAST({find.format(t=t)} > 0 AS INTEGER)" for t in SOFT_TERMS)
    return f"CAST({strict} AS INTEGER) AS strict_hits, CAST({soft} AS INTEGER) AS soft_hits, CAST({distinct} AS INTEGER) AS soft_terms"


OP10_SQL = rf"""
WITH b AS (SELECT page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_terms_sql()}, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM b),
r AS (SELECT v.* FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) v(what, rh, rp)),
m AS (SELECT h.*, (SELECT arg_max(what || ' ' || rh || rp, length(rh || rp)) FROM r WHERE (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp)) AS hit FROM h)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, strict_hits, soft_hits, soft_terms,
  coalesce(split_part(hit, ' ', 1), CASE WHEN strict_hits > 0 OR soft_terms >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""
