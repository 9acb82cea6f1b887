"""Answers from streamed lines, progress on packs, and pages that arrive one after another."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from lexloom.functions.text import docset_key
from lexloom.operators import ingest
from lexloom.operators.index import merge_pages
from lexloom.operators.packs import mirrored
from lexloom.streaming.sessions import latest_stream


def delta(line: Column) -> Column:
    """The text that an event line adds; null for blanks, the end mark, other lines and bad JSON."""
    payload = F.trim(F.regexp_extract(F.trim(line), r"(?s)^data:(.*)$", 1))
    return F.when(~payload.isin("", "[DONE]"), F.get_json_object(payload, "$.choices[0].delta.content"))


def assembled(lines: DataFrame, key: str = "chat_id", order: str = "seq") -> DataFrame:
    """key, answer and status: the deltas of lines (key, order, line) in order; where nothing came the answer is null and the status is empty, an error. Batch, or a stream in complete or update mode."""
    parts = lines.select(key, order, delta(F.col("line")).alias("delta"))
    got = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct(order, "delta")))).alias("found"))  # an answer's own lines
    answer = F.nullif(F.array_join(F.transform("found", lambda x: x["delta"]), ""), F.lit(""))
    return got.select(key, answer.alias("answer"), F.when(answer.isNull(), "empty").otherwise("whole").alias("status"))


def finished(lines: DataFrame, key: str = "chat_id", order: str = "seq", at: str = "at", late: str = "10 minutes") -> DataFrame:
    """A stream of assembled rows, each once: an answer's state ends with its end mark, or when no line came for `late` of its time.

    lines has key, order, at (a time) and line. An answer that the end mark
    doesn't close has the status cut. Lines of an answer that is closed begin a new one.
    """
    kinds = dict(lines.dtypes)
    rows = lines.withWatermark(at, late).select(key, order, at, delta(F.col("line")).alias("delta"), F.trim("line").rlike(r"^data:\s*\[DONE\]$").alias("done"))

    def add(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        orders, deltas, last = state.get if state.exists else ([], [], 0)
        held, done = list(zip(orders, deltas)), state.hasTimedOut
        for pdf in batches:
            if pdf.empty:  # a timeout has no lines
                continue
            held += [(int(n), d) for n, d in zip(pdf["order"], pdf["delta"]) if d is not None]
            last, done = max(last, int(pdf["millis"].max())), done or bool(pdf["done"].any())
        if done:
            answer = "".join(d for _, d in sorted(held)) or None
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [keys[0]], "answer": [answer], "status": ["empty" if answer is None else "cut" if state.hasTimedOut else "whole"]})
        else:
            state.update(([n for n, _ in held], [d for _, d in held], last))
            state.setTimeoutTimestamp(max(last + late_ms, state.getCurrentWatermarkMs() + 1))

    late_ms = int(lines.sparkSession.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {late}"))).first()[0])
    shaped = rows.select(key, F.col(order).cast("bigint").alias("order"), at, F.unix_millis(F.col(at)).alias("millis"), "delta", "done")
    return shaped.groupBy(key).applyInPandasWithState(add, f"{key} {kinds[key]}, answer string, status string", "orders array<bigint>, deltas array<string>, last bigint", "append", "EventTimeTimeout")


def pack_states(progress: DataFrame, packs: DataFrame | None = None) -> DataFrame:
    """docset, state and progress that the last progress row (id, seq, state, docset, progress) of each pack shows; batch or stream.

    With packs (id), a table that doesn't stream, rows of unknown packs are left out.
    """
    rows = mirrored(progress if "progress" in progress.columns else progress.withColumn("progress", F.lit(None).cast("double")))
    if packs is not None:
        rows = rows.join(packs.select(F.col("id").alias("docset")).distinct(), "docset", "left_semi")
    return latest_stream(rows.select("docset", "seq", "state", "progress"), "docset", ["seq"])


def ingest_stream(landing: DataFrame, folder: str, base: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Parses, chunks and indexes files (docset, version, path, content) that land, page by page.

    A file replaces the page of its stem and path and nothing else; one without
    text removes it. Of a batch's files with one stem and path the last by the
    column order counts (the greatest content, without one). A batch that the
    index has is not added again.
    """
    by = [order] if order else []

    def add(batch: DataFrame, number: int) -> None:
        files = batch.withColumn("stem", ingest.index_stem(docset_key(F.col("docset")))).groupBy("stem", "path").agg(F.max(F.struct(*by, "content", "docset", "version")).alias("f"))
        files = files.select("stem", "path", "f.docset", "f.version", "f.content")
        pages = ingest.parse_pages(files, base, keep=("docset", "version"))
        rows = ingest.index_rows(ingest.chunk_pages(pages)).withColumnsRenamed({"id": "chunk_id", "page_path": "path"})
        rows = rows.select("stem", "path", "chunk_id", "docset", "version", "title", "section", "url", "text", "symbols", "embedding", "indexed")
        merge_pages(rows, files, folder, f"{checkpoint}:{number}")

    return landing.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
