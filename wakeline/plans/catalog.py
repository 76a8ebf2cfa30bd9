"""The catalogue of registered queries: a name, the DataFrame function, and the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The fact table over the driver's tables, as DuckDB reads it (the Spark side is sources.captures).
CAPTURES_SQL = """
n AS (SELECT (SELECT count(*) FROM pages) np, (SELECT count(*) FROM documents) nd, (SELECT count(*) FROM embeddings) nv),
e AS (SELECT event_id AS capture_id, user_id, date_trunc('second', ts) AS ts,
  CASE event_type WHEN 'click' THEN 'Browser' WHEN 'view' THEN 'Browser' WHEN 'error' THEN 'Terminal' WHEN 'signup' THEN 'Mail' ELSE 'Notes' END AS app,
  (user_id * 5 + event_id % 5) % np AS page_ix, (event_id * 31 + user_id) % nd AS doc_ix, np, nv, event_id FROM events CROSS JOIN n),
captures_v AS (SELECT e.capture_id, e.user_id, e.ts, e.app,
  CASE WHEN e.app = 'Browser' THEN concat('(', cast(e.event_id % 7 AS varchar), ') Page ', cast(e.page_ix AS varchar))
    WHEN e.event_id % 4 = 0 THEN concat(e.app, ' item ', cast(e.event_id % 3 AS varchar), ' (', cast(e.event_id % 9 AS varchar), ')')
    ELSE concat(e.app, ' item ', cast(e.event_id % 3 AS varchar)) END AS window_title,
  CASE WHEN e.app = 'Browser' THEN p.url END AS url, d.text AS ocr_text, v.embedding
  FROM e JOIN pages p ON p.page_id = e.page_ix JOIN documents d ON d.doc_id = e.doc_ix JOIN embeddings v ON v.vec_id = (e.page_ix * 7 + e.event_id % 3) % e.nv),
keyed AS (SELECT *, CASE WHEN regexp_matches(trim(url), '^(?i)https?://[^/?#]+') THEN
    lower(regexp_extract(trim(url), '^([^:]+://[^/?#]+)', 1)) || coalesce(nullif(rtrim(lower(regexp_extract(trim(url), '^[^:]+://[^/?#]+([^?#]*)', 1)), '/'), ''), '/')
  ELSE CASE WHEN nt = '' THEN lower(trim(app)) ELSE lower(trim(app)) || '::' || nt END END AS page_key
  FROM (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(window_title, '')), '\\s*[\\(\\[]\\s*\\d+\\s*[\\)\\]]\\s*$', ''), '^\\s*[\\(\\[]?\\d+[\\)\\]]?\\s+', ''), '\\s+', ' ', 'g'))) AS nt FROM captures_v)),
queries_v AS (SELECT conv_id * 1000 + turn AS query_id, conv_id % 15 AS user_id, text, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 37 + turn) AS ts, embedding
  FROM conversations JOIN embeddings ON vec_id = ((conv_id % 15) * 11 + (turn // 4) % 2) % (SELECT count(*) FROM embeddings) WHERE role = 'user')
"""


def over_captures(select: str, ctes: str = "") -> str:
    """SQL over captures_v, keyed (captures_v with page_key) and queries_v."""
    return "WITH " + CAPTURES_SQL.strip() + (", " + ctes if ctes else "") + " " + select


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
