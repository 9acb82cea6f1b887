"""Reading Parquet tables of a folder, and the folder that all executors share."""

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from lexloom.sources.files import delete

#: Folders made within a clearing.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder where that is unset and all runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(top or tempfile.mkdtemp(prefix='lexloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, errors included, what folders of intermediate tables were made within it.

    Results are lazy, so write them to a place of their own before it ends. Clearings nest: each has its own folders.
    """
    made: list[str] = []
    before = _made.set(made)
    try:
        yield
    finally:
        _made.reset(before)
        for path in made:
            delete(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new shared folder and read again: computed once, and not lost with an executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df for work that takes far longer than reading: rows of a few files go to all cores; where there are partitions for each core, nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
