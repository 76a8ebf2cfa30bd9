"""JN-7 and STR-7: what goes with deleted captures, over a declared graph of tables, and which captures grow too old."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import over_captures, query
from ..sources import versions
from ..sources.captures import captures, query_log
from ..sources.scratch import BROADCAST_ROWS, written


@dataclass(frozen=True)
class Derived:
    """A table of the graph: its rows' key (unique, not null) and where they come from: (column of ids, table that they are keys of); the column may be an array."""

    rows: DataFrame
    key: str
    sources: list[tuple[str, str]] = field(default_factory=list)


def _hinted(keys: DataFrame) -> DataFrame:
    return keys.hint("broadcast" if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else "merge")


def cascade(gone: DataFrame, tables: dict[str, Derived], root: str = "captures") -> dict[str, DataFrame]:
    """The rows of each table that stay when the keys in gone (one column) leave the root table.

    A row goes if any of its sources goes, whatever table that is in; a row without sources stays.  tables are in an order in which sources come first.
    """
    left = {root: written(gone.toDF("gone").where("gone IS NOT NULL").distinct(), "gone")}
    out = {}
    for name, table in tables.items():
        if name != root:
            hit = None
            for column, of in table.sources:
                if of not in left:
                    raise ValueError(f"{name} comes from {of}, which is not before it")
                array = table.rows.schema[column].dataType.typeName() == "array"
                ids = table.rows.select(F.col(table.key).alias("_key"), (F.explode(column) if array else F.col(column)).alias("gone"))
                own = ids.join(_hinted(left[of]), "gone", "left_semi").select("_key")
                hit = own if hit is None else hit.unionByName(own)
            left[name] = written((hit if hit is not None else left[root].where("false").select(F.col("gone").alias("_key"))).select(F.col("_key").alias("gone")).distinct(), "gone")
        out[name] = table.rows.join(_hinted(left[name]), F.col(table.key) == F.col("gone"), "left_anti")
    return out


def forget(spark: SparkSession, root: str, gone: DataFrame, tables: dict[str, Derived]) -> str:
    """The cascade as one step: all tables are written without what goes, and readers of the set see it at once (sources.versions)."""
    return versions.commit(spark, root, cascade(gone, tables))


def expired(df: DataFrame, recalled: DataFrame, now: Column, days: int = 183, at_most: int = 366) -> DataFrame:
    """STR-7: (capture_id) older than so many days and never recalled, or older than at_most days."""
    age = F.timestamp_diff("SECOND", F.col("ts").cast("timestamp"), now.cast("timestamp")) / 86400
    seen = recalled.select("capture_id").distinct().withColumn("_recalled", F.lit(True))
    return df.join(seen.hint("merge"), "capture_id", "left").where((age > at_most) | ((age > days) & F.col("_recalled").isNull())).select("capture_id")


def _graph(spark, sf_dir) -> dict[str, Derived]:
    """The fixture's derived tables: commitments and their reminders, series, alerts, episodes of a user's day, and pins."""
    df = captures(spark, sf_dir)
    i = F.col("capture_id")
    commitments = df.where(i % 13 < 5).select((i * 10).alias("commitment_id"), "capture_id")
    reminders = commitments.where("commitment_id % 20 = 0").select((F.col("commitment_id") + 7).alias("reminder_id"), "commitment_id")
    alerts = df.where(i % 17 == 0).select(i.alias("alert_id"), F.expr("capture_id div 2").alias("match_id"), "capture_id")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    episodes = df.groupBy((F.col("user_id") * 1000 + day).alias("episode_id")).agg(F.collect_list("capture_id").alias("capture_ids"))
    pins = query_log(spark, sf_dir).select(F.col("query_id").alias("pin_id"), F.when(F.col("query_id") % 5 != 0, F.array(F.col("query_id") % 1000, F.col("query_id") * 7 % 1000)).alias("capture_ids"))
    return {
        "captures": Derived(df, "capture_id"), "commitments": Derived(commitments, "commitment_id", [("capture_id", "captures")]), "reminders": Derived(reminders, "reminder_id", [("commitment_id", "commitments")]),
        "series": Derived(df.where("app <> 'Mail'").select(i.alias("event_id")), "event_id", [("event_id", "captures")]), "alerts": Derived(alerts, "alert_id", [("match_id", "captures"), ("capture_id", "captures")]),
        "episodes": Derived(episodes, "episode_id", [("capture_ids", "captures")]), "pins": Derived(pins, "pin_id", [("capture_ids", "captures")]),
    }


@query("retention_cascade", over_captures(
    "SELECT 'captures' AS name, count(*) AS n, sum(capture_id) AS keys FROM captures_v WHERE capture_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'commitments', count(*), sum(capture_id * 10) FROM captures_v WHERE capture_id % 13 < 5 AND capture_id NOT IN (SELECT id FROM gone) "
    "UNION ALL SELECT 'reminders', count(*), sum(capture_id * 10 + 7) FROM captures_v WHERE capture_id % 13 < 5 AND capture_id % 2 = 0 AND capture_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'series', count(*), sum(capture_id) FROM captures_v WHERE app <> 'Mail' AND capture_id NOT IN (SELECT id FROM gone) "
    "UNION ALL SELECT 'alerts', count(*), sum(capture_id) FROM captures_v WHERE capture_id % 17 = 0 AND capture_id NOT IN (SELECT id FROM gone) AND capture_id // 2 NOT IN (SELECT id FROM gone) "
    "UNION ALL SELECT 'episodes', count(*), sum(e) FROM (SELECT user_id * 1000 + date_diff('day', DATE '2024-01-01', ts::DATE) AS e FROM captures_v GROUP BY 1 HAVING NOT bool_or(capture_id IN (SELECT id FROM gone))) "
    "UNION ALL SELECT 'pins', count(*), sum(query_id) FROM queries_v WHERE query_id % 5 = 0 OR (query_id % 1000 NOT IN (SELECT id FROM gone) AND query_id * 7 % 1000 NOT IN (SELECT id FROM gone))",
    "gone AS (SELECT capture_id AS id FROM captures_v WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 25 DAY OR (ts < TIMESTAMP '2024-01-31' - INTERVAL 12 DAY AND capture_id % 11 <> 0))"))
def retention_cascade(spark, sf_dir) -> DataFrame:
    """STR-7 with JN-7: what is left of each table, and the sum of its keys, when captures grow too old (12 and 25 days here)."""
    df = captures(spark, sf_dir)
    gone = expired(df, df.where("capture_id % 11 = 0"), F.lit("2024-01-31").cast("timestamp_ntz"), 12, 25)
    graph = _graph(spark, sf_dir)
    out = None
    for name, rows in cascade(gone, graph).items():
        part = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(graph[name].key).alias("keys"))
        out = part if out is None else out.unionByName(part)
    return out
