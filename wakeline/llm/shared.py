"""Session helpers of this subpackage: the shared folder, stored intermediate tables, bounded semi joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many keys a side is broadcast (16 bytes a key or so); beyond it the join shuffles.
BROADCAST_ROWS = 300_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set and all tasks run in this process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wakeline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/wakeline/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, and any executor may be lost."""
    path = new_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes what :func:`stored` wrote for tables that nothing will read again."""
    for table in tables:
        for file in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most so many rows; it is counted no further than that."""
    return df.limit(most + 1).count() <= most


def keep_ids(df: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of df whose key (or keys) is in ids (distinct): broadcast behind a count, a shuffled semi join beyond it."""
    return df.join(F.broadcast(ids) if small(ids) else ids.hint("merge"), key, "left_semi")
