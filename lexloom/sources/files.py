"""Folders on whatever file system Spark writes to."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str):
    """Hadoop's file system and path of a name."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order; none if there is no such folder."""
    system, there = located(spark, path)
    return sorted(unquote(x.getPath().getName()) for x in system.listStatus(there)) if system.exists(there) else []


def delete(spark: SparkSession, path: str) -> None:
    """A folder with all it holds; nothing happens if there is none."""
    system, there = located(spark, path)
    system.delete(there, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a folder."""
    system, there = located(spark, path)
    return system.getContentSummary(there).getLength() if system.exists(there) else 0
