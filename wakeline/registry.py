"""All queries of the activity-memory operators, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import alerts, answers, cards, cascade, commitments, daymap, diffs, episodes, facts, filters, history, memory, places, positions, proposals, readings, recall, rescue, retrieval, sessions, text, threads, timewords  # noqa: F401  (they register)
from .plans.catalog import ORACLES, QUERIES, Query
from .streaming import feeds  # noqa: F401  (registers too)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["time_report"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
