"""Sets of tables that change together: a version is written beside the old one, and a single pointer moves to it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "CURRENT"
_MANIFEST = "bucket int, path string"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that holds now, or None before the first."""
    where, files = _files(spark, f"{root}/{_POINTER}")
    if not files.exists(where):
        return None
    return f"{root}/{spark.read.text(f'{root}/{_POINTER}').first()[0]}"


def read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the version that holds now; empty before the first."""
    at = current(spark, root)
    return spark.createDataFrame([], schema) if at is None else spark.read.schema(schema).parquet(f"{at}/{name}")


def point_to(spark: SparkSession, root: str, version: str) -> None:
    """Moves the pointer by one rename over the old one, which is atomic on the file systems that Hadoop calls consistent: readers see the old set or the new."""
    fs, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    fresh, files = _files(spark, f"{root}/.{_POINTER}-{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    out.write(version.encode())
    out.close()
    how = gateway.new_array(fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, fs.Path(f"{root}/{_POINTER}"), how)


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Writes all tables of a new version, then lets the pointer move to it.  A run that fails before that leaves the old version as it was."""
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    point_to(spark, root, version)
    return f"{root}/{version}"


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merged(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of a merged table as they hold now."""
    at = current(spark, root)
    if at is None:
        return spark.createDataFrame([], schema)
    paths = [r.path for r in spark.read.schema(_MANIFEST).parquet(f"{at}/manifest").collect()]  # one for each bucket at most
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def last_batch(spark: SparkSession, root: str) -> int:
    """The number of the last merged batch, or -1."""
    found = read(spark, root, "mark", "batch long").first()
    return -1 if found is None else found.batch


def merge(spark: SparkSession, root: str, changes: DataFrame, batch: int, schema: str, keys: list[str], order: str, buckets: int = 64) -> bool:
    """SNK-3 as a resumable step: one row for each key, the last write by a column of order wins (of equal ones the change).

    Rows lie in buckets by a hash of their keys; only buckets with a change are read and written again.  The new manifest of buckets and the batch's number
    are one version, so a run that is killed before the pointer moves has changed nothing, and a batch that comes again is passed over (False).
    """
    if batch <= last_batch(spark, root):
        return False
    at, columns = current(spark, root), spark.createDataFrame([], schema).columns
    old = {} if at is None else {r.bucket: r.path for r in spark.read.schema(_MANIFEST).parquet(f"{at}/manifest").collect()}
    changes = changes.select(*columns).withColumn("_bucket", _bucket(keys, buckets)).withColumn("_from", F.lit(1))
    touched = [r[0] for r in changes.select("_bucket").distinct().collect()]
    held = [old[b] for b in touched if b in old]
    if held:
        before = spark.read.schema(schema).parquet(*held).withColumn("_bucket", _bucket(keys, buckets)).withColumn("_from", F.lit(0))
        changes = before.unionByName(changes)
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns, "_bucket"), F.struct(order, "_from")).alias("x")).select("x.*")
    data = f"{root}/data-{uuid.uuid4().hex}"
    last.repartition("_bucket").write.partitionBy("_bucket").parquet(data)
    now = old | {b: f"{data}/_bucket={b}" for b in touched}
    commit(spark, root, {"manifest": spark.createDataFrame(sorted(now.items()), _MANIFEST), "mark": spark.createDataFrame([(batch,)], "batch long")})
    return True


def merge_stream(feed: DataFrame, root: str, checkpoint: str, schema: str, keys: list[str], order: str) -> None:
    """Merges everything new of a stream, a batch at a time; a batch that was merged before a crash is not merged twice."""
    spark = feed.sparkSession
    step = lambda changes, batch: merge(spark, root, changes, batch, schema, keys, order)
    feed.writeStream.foreachBatch(lambda df, n: (step(df, n), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
