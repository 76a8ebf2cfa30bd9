"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rows of keys are broadcast; beyond it a join shuffles.
BROADCAST_ROWS = 300_000
#: Up to so many hashes of keys are (eight bytes each, some 40 in a task's table).
BROADCAST_HASHES = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, and all tasks run on this machine, a folder of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="wakeline-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: it is made once, its size is known, and a lost executor costs its tasks only."""
    path = f"{shared_folder(df.sparkSession)}/wakeline/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def among(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose columns are in keys (a written table of distinct rows): broadcast behind a count, a shuffled semi join beyond it."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(keys.hint("broadcast" if few else "merge"), on, "left_semi")


def hashed_among(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose columns have the hash of a row of keys (on: a written table, without nulls): a few others that share one may stay, so a later join has to tell them.

    Hashes are broadcast where the keys would not be, so that words nobody asked for go before anything is shuffled."""
    hashes = written(keys.select(F.xxhash64(*on).alias("_h")).distinct(), "hashes")
    few = hashes.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    return df.withColumn("_h", F.xxhash64(*on)).join(hashes.hint("broadcast" if few else "merge"), "_h", "left_semi").drop("_h")


def of_askers(df: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows of df (user_id, ...) of users who ask a question; the others go before their texts are read."""
    return among(df, written(questions.select("user_id").distinct(), "askers"), ["user_id"])


def of_captures(df: DataFrame, pairs: DataFrame, *ids: str) -> DataFrame:
    """Rows of df (capture_id, ...) that a written table names in one of its columns; the others go before their texts are read."""
    named = None
    for c in ids:
        some = pairs.select(pairs[c].alias("capture_id"))
        named = some if named is None else named.unionByName(some)
    return among(df, written(named.distinct(), "named"), ["capture_id"])
