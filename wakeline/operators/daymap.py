"""GRA-4: the map of each user's day: places with names and topics, switches between them, the walk, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import ORACLES, over_captures, query
from ..sources.captures import captures, table
from .cards import clean_title, without_shared_prefix
from .memory import place_vectors, topic_clusters
from .places import place_labels
from .sessions import attention_trace, place_stats, with_dwell

LEAST_SWITCHES = 2


def day_labels(df: DataFrame) -> DataFrame:
    """TXT-15 to 17 for a day: (user_id, day, page_key, label), from that day's titles."""
    own = df.select(F.struct("user_id", F.to_date("ts").alias("day")).alias("user_id"), "page_key", "app", clean_title(F.coalesce("window_title", F.lit(""))).alias("window_title"))
    labels = place_labels(own).select("user_id.user_id", "user_id.day", "page_key", "label")
    return without_shared_prefix(labels, ["user_id", "day"])


def day_maps(df: DataFrame, width: int) -> DataFrame:
    """captures (capture_id, user_id, ts, app, window_title, url, page_key, embedding of a width) to a row for each user's day with places:
    (user_id, day, nodes, edges, trace, captures, pages, minutes).

    nodes    AGG-5's places by dwell: (id from 0, page_key, label, app, url, minutes, visits, first_ts, last_ts, capture_id of the first capture, cluster);
             the cluster is null for a place without a vector
    edges    AGG-6: (a, b, weight) between ids, walked LEAST_SWITCHES times or more, the heaviest first
    trace    WIN-3: (ts, node) where a day goes on at another place
    A day has MOST_PLACES places at most; its walk is as long as its captures.
    """
    day = ["user_id", "day"]
    key = [*day, "page_key"]
    kept = place_stats(df).select(*key, "place", "dwell", "visits", "first_ts", "last_ts")
    order = F.struct("ts", "capture_id")
    first = df.withColumn("day", F.to_date("ts")).groupBy(*key).agg(F.min_by("app", order).alias("app"), F.min_by("url", F.when(F.col("url").isNotNull(), order)).alias("url"), F.min_by("capture_id", order).alias("capture_id"))
    clusters = topic_clusters(place_vectors(df, width)).select(*key, "cluster")
    named = kept.join(first.hint("merge"), key).join(day_labels(df).hint("merge"), key).join(clusters.hint("merge"), key, "left")
    node = F.struct((F.col("place") - 1).cast("int").alias("id"), "page_key", "label", "app", "url", F.round(F.col("dwell") / 60, 1).alias("minutes"), "visits", "first_ts", "last_ts", "capture_id", "cluster")
    nodes = named.groupBy(*day).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    ids = kept.select(*key, (F.col("place") - 1).cast("int").alias("node"))
    walk = attention_trace(df).join(ids.hint("merge"), key)
    came = ids.withColumnRenamed("page_key", "left_key").withColumnRenamed("node", "from")
    trace = walk.groupBy(*day).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "capture_id", "node"))), lambda x: F.struct(x["ts"].alias("ts"), x["node"].alias("node"))).alias("trace"))
    pairs = walk.join(came.hint("merge"), [*day, "left_key"]).groupBy(*day, F.least("node", "from").alias("a"), F.greatest("node", "from").alias("b")).agg(F.count("*").alias("weight")).where(F.col("weight") >= LEAST_SWITCHES)
    edges = pairs.groupBy(*day).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "a", "b"))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), (-x["w"]).alias("weight"))).alias("edges"))
    totals = with_dwell(df).groupBy(*day).agg(F.count("*").alias("captures"), F.countDistinct("page_key").alias("pages"), F.bround(F.sum("dwell") / 60).cast("long").alias("minutes"))
    none = F.array().cast(edges.schema["edges"].dataType)
    out = nodes.join(edges.hint("merge"), day, "left").join(trace.hint("merge"), day).join(totals.hint("merge"), day)
    return out.select(*day, "nodes", F.coalesce("edges", none).alias("edges"), "trace", "captures", "pages", "minutes")


def _lines(rows: str, fields: list[str]) -> Column:
    return F.transform(rows, lambda x: F.concat_ws("|", *(F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields)))


_NODE, _EDGE, _STEP = ["id", "page_key", "label", "app", "url", "minutes", "visits", "capture_id", "cluster"], ["a", "b", "weight"], ["ts", "node"]
_TITLE = "trim(regexp_replace(regexp_replace(window_title, '\\s*[\\(\\[]\\s*\\d+\\s*[\\)\\]]\\s*$', ''), '^\\s*[\\(\\[]?\\d+[\\)\\]]?\\s+', ''))"
_JOINED = lambda *parts: "concat_ws('|', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '-')" for p in parts) + ")"


@query("day_maps", over_captures(
    f"SELECT user_id, day, nodes, coalesce(edges, []::VARCHAR[]) AS edges, trace, captures, pages, minutes FROM (SELECT user_id, day, list({_JOINED('place - 1', 'page_key', 'label', 'app', 'url', 'round(dwell / 60.0::DOUBLE, 1)', 'visits', 'capture_id', 'cluster')} ORDER BY place) AS nodes FROM pl JOIN fi USING (user_id, day, page_key) JOIN la USING (user_id, day, page_key) LEFT JOIN tc USING (user_id, day, page_key) GROUP BY 1, 2) "
    f"JOIN (SELECT tr.user_id, tr.day, list({_JOINED('tr.ts', 'pl.place - 1')} ORDER BY tr.ts, tr.capture_id) AS trace FROM tr JOIN pl USING (user_id, day, page_key) GROUP BY 1, 2) USING (user_id, day) JOIN dt USING (user_id, day) "
    f"LEFT JOIN (SELECT user_id, day, list({_JOINED('x', 'y', 'weight')} ORDER BY weight DESC, x, y) AS edges FROM (SELECT pe.user_id, pe.day, least(p.place, q.place) - 1 AS x, greatest(p.place, q.place) - 1 AS y, weight FROM pe JOIN pl p ON p.user_id = pe.user_id AND p.day = pe.day AND p.page_key = pe.a JOIN pl q ON q.user_id = pe.user_id AND q.day = pe.day AND q.page_key = pe.b) GROUP BY 1, 2) USING (user_id, day)",
    ", ".join(f"{name} AS MATERIALIZED ({ORACLES[of]})" for name, of in (("pl", "day_places"), ("tr", "attention_trace"), ("pe", "place_edges"), ("dt", "day_totals"))) + f", tc AS MATERIALIZED (SELECT user_id, day, page_key, cluster FROM ({ORACLES['topic_clusters']})), "
    "fi AS (SELECT user_id, ts::DATE AS day, page_key, arg_min(app, (ts, capture_id)) AS app, arg_min(url, (ts, capture_id)) FILTER (WHERE url IS NOT NULL) AS url, arg_min(capture_id, (ts, capture_id)) AS capture_id FROM keyed GROUP BY 1, 2, 3), "
    f"la AS (SELECT user_id, day, page_key, left(CASE WHEN len(title) >= 3 THEN title ELSE page_key END, 48) AS label FROM (SELECT user_id, day, page_key, title, row_number() OVER (PARTITION BY user_id, day, page_key ORDER BY count(*) DESC, len(title) DESC, title) AS r FROM (SELECT user_id, ts::DATE AS day, page_key, {_TITLE} AS title FROM keyed) GROUP BY 1, 2, 3, 4) WHERE r = 1)"))
def day_maps_q(spark, sf_dir) -> DataFrame:
    """GRA-4, each node, edge and step as a line."""
    width = table(spark, sf_dir, "embeddings").select(F.max(F.size("embedding"))).first()[0] or 1
    maps = day_maps(captures(spark, sf_dir, vectors=True, keyed=True), width)
    return maps.select("user_id", "day", _lines("nodes", _NODE).alias("nodes"), _lines("edges", _EDGE).alias("edges"), _lines("trace", _STEP).alias("trace"), "captures", "pages", "minutes")
