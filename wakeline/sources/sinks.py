"""Sinks: CSV export, day rebuilds, logs of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str, key: str = "capture_id") -> None:
    """SNK-1: CSV with a header; files follow each other in the order of the key."""
    df.orderBy(key).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def rebuild_days(df: DataFrame, path: str, day: str = "day") -> None:
    """SNK-4: replaces the days that df holds and leaves the others; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """SNK-3: one row for each key, the last write wins; of equal times the change does."""
    cols = current.columns
    both = current.withColumn("_from", F.lit(0)).unionByName(changes.select(*cols).withColumn("_from", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(at, "_from")).alias("x"))
    return last.select("x.*")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-4: JSON lines under a schema; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
