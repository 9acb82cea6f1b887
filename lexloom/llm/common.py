"""Expressions shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.files import delete
from lexloom.sources.tables import new_folder

#: White space between words, as a Java regular expression.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def space_words(text: Column) -> Column:
    """The words of a text between white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or local_folder(spark.sparkContext.applicationId)


@lru_cache
def local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"{application}-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder and read again, so that a lost executor loses nothing.

    Parquet takes a fraction of the room of Spark's own checkpoint files.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that checkpointed wrote, once nothing reads them any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("table-"):
                delete(df.sparkSession, unquote(folder))


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """The session's setting has this value within it, for what runs there, and its own one afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, a table of a few numbers a row, to be broadcast if it has at most `most` rows; beyond that, a join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
