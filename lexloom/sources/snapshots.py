"""Versions of a folder of immutable segments.

A segment is a folder of Parquet tables that nothing changes once it is written. The
log is a Parquet table; each commit appends one file with a row for each stem that the
commit adds to or takes from a segment. Spark moves that file into place at the end, so
that a reader sees all of a commit or nothing. Readers bind to a version: what was
committed up to it. What no commit names, a failed write for one, is never read.

There is one writer at a time.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import Row, SparkSession
from pyspark.sql.utils import AnalysisException

from lexloom.sources.files import children, delete

#: action is add or remove; n, total and replaced are of the segment's rows of the stem: chunks and terms more than before, and pages that were there before.
LOG = "version bigint, batch string, action string, stem string, segment string, n bigint, total bigint, replaced bigint"


def log_rows(spark: SparkSession, folder: str, version: int | None = None) -> list[Row]:
    """All rows up to a version: one for each stem of each commit."""
    try:
        rows = spark.read.schema(LOG).parquet(f"{folder}/log").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [r for r in rows if version is None or r["version"] <= version]


def live(rows: list[Row]) -> list[Row]:
    """The rows of segments that are added and not removed later, in order of their versions."""
    gone = {(r["stem"], r["segment"]) for r in rows if r["action"] == "remove"}
    return sorted((r for r in rows if r["action"] == "add" and (r["stem"], r["segment"]) not in gone), key=lambda r: (r["version"], r["stem"]))


def latest(rows: list[Row]) -> int:
    return max((r["version"] for r in rows), default=0)


def new_segment() -> str:
    return uuid.uuid4().hex


def commit(spark: SparkSession, folder: str, batch: str, version: int, added: list[tuple], removed: list[tuple[str, str]]) -> None:
    """added: (stem, segment, n, total, replaced); removed: (stem, segment)."""
    rows = [(version, batch, "add", *a) for a in added] + [(version, batch, "remove", *r, 0, 0, 0) for r in removed]
    # a commit of nothing is remembered too, for its batch
    rows = rows or [(version, batch, "none", None, None, 0, 0, 0)]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def has_batch(rows: list[Row], batch: str) -> bool:
    return any(r["batch"] == batch for r in rows)


def vacuum(spark: SparkSession, folder: str, keep: int | None = None) -> None:
    """Delete the files of segments, and of stems in segments, that no version from keep (the latest, if None) on reads."""
    rows = log_rows(spark, folder)
    versions = {r["version"] for r in rows if keep is not None and r["version"] >= keep} | {latest(rows)}
    used = {(r["stem"], r["segment"]) for v in versions for r in live([r for r in rows if r["version"] <= v])}
    for segment in children(spark, f"{folder}/segments"):
        stems = {s for s, g in used if g == segment}
        if not stems:
            delete(spark, f"{folder}/segments/{segment}")
            continue
        for table in children(spark, f"{folder}/segments/{segment}"):
            for name in children(spark, f"{folder}/segments/{segment}/{table}"):
                if name.startswith("stem=") and name.removeprefix("stem=") not in stems:
                    delete(spark, f"{folder}/segments/{segment}/{table}/stem={escaped(name.removeprefix('stem='))}")


def escaped(value: str) -> str:
    """A partition's value as its folder is named: signs that file systems or Spark give a meaning are written as %XX."""
    return "".join(quote(c, safe="") if c in "\"#%'*/:=?\\{[]^\x7f" or ord(c) < 32 else c for c in value)
