"""SRC-3: documents from folders of files, read again where a file's time has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import credential
from . import versions

DOCUMENTS = "path string, mtime timestamp, text string"


def listing(spark: SparkSession, folders: list[str], pattern: str = "*.{txt,md}") -> DataFrame:
    """(path, mtime) of the files below folders; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folders)
    return files.select("path", F.col("modificationTime").alias("mtime"))


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mtime, text) of some files; bytes that are not UTF-8 are replaced."""
    if not paths:
        return spark.createDataFrame([], DOCUMENTS)
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def reindex(spark: SparkSession, folders: list[str], index: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """Brings an index (a set of versions) up to date with folders; returns (path, action, reason).

    indexed: new, or with another time; refused: such a one that holds a credential (reason) and is not taken over, an older version of it stays; removed:
    no longer there.  Files with the same time give no row and aren't opened.  The paths of changed files pass through the driver, as the listing of any
    file source does.  The index changes at once at the end: a run that fails leaves it as it was.
    """
    old, now = versions.read(spark, index, "documents", DOCUMENTS), listing(spark, folders, pattern)
    was = old.select("path", F.col("mtime").alias("was"))
    changed = [r.path for r in now.join(was, "path", "left").where("was IS NULL OR was <> mtime").select("path").collect()]
    fresh = contents(spark, changed).withColumn("reason", credential("text"))
    removed = was.join(now, "path", "left_anti").select("path", F.lit("removed").alias("action"), F.lit(None).cast("string").alias("reason"))
    report = removed.unionByName(fresh.select("path", F.when(F.col("reason").isNull(), "indexed").otherwise("refused").alias("action"), "reason"))
    taken = fresh.where("reason IS NULL").select("path", "mtime", "text")
    kept = old.join(taken.select("path").hint("merge"), "path", "left_anti").join(now.select("path").hint("merge"), "path", "left_semi")
    at = versions.commit(spark, index, {"report": report, "documents": kept.unionByName(taken)})
    return spark.read.schema("path string, action string, reason string").parquet(f"{at}/report")
