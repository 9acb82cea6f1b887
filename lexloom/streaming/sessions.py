"""Streaming twins of the event jobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest row of each key; write in update mode."""
    rest = [c for c in events.columns if c not in (key, *order)]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("last")).select(key, "last.*")


def latest_within(events: DataFrame, key: str, order: list[str], at: str, late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """key, span_start and the latest row of each key and span of time: a span's state ends once the watermark has passed it, so that state is bounded by the keys of the last spans. Append or update mode."""
    rest = [c for c in events.columns if c not in (key, *order)]
    spans = events.withWatermark(at, late).groupBy(key, F.window(at, span).alias("w"))
    return spans.agg(F.max(F.struct(*order, *rest)).alias("last")).select(key, F.col("w.start").alias("span_start"), "last.*")


def session_stream(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Sessions that end after 15 idle minutes; a window merges at exactly its gap, hence the microsecond less."""
    window = F.session_window(at, "899999999 microseconds")
    return events.withWatermark(at, late).groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(key, "w.start", "n_events")
