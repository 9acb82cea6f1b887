"""From a table of asks to cited evidence: plans, hybrid search within each ask's scope, merging, evidence and prompts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators import evidence, planner
from lexloom.operators.index import Index, search_index
from lexloom.operators.vectors import ASK_CANDIDATES, cosine_topk, embed, fuse, merged_queries, resolved_scope
from lexloom.sources.tables import stored

#: The columns of a chunk that an answer shows.
SHOWN = ("docset", "version", "title", "section", "url", "text")


def plan_queries(plans: DataFrame, asks: DataFrame) -> DataFrame:
    """query_id, ask_id, query_no, question, symbols, docsets (the ask's scope) and result_count of every query of the plans; asks may have docsets, the allowed ones."""
    none = F.array().cast("array<string>")
    allowed = asks.select("ask_id", (F.coalesce("docsets", none) if "docsets" in asks.columns else none).alias("allowed"))
    rows = plans.join(allowed, "ask_id").select("ask_id", F.posexplode("queries").alias("query_no", "question"), "symbols", resolved_scope(F.col("docsets"), F.col("allowed")).alias("docsets"), "result_count")
    return rows.withColumn("query_id", F.concat_ws(":", "ask_id", "query_no"))


def retrieve(index: Index, queries: DataFrame, embed_fn: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """ask_id, chunk_id, score, rank, lexical_score, semantic_score of the hits of each ask (queries as of plan_queries).

    Each query's lists of ASK_CANDIDATES rows are fused, exact symbols raise
    candidates, and the best result_count of the queries are merged by the best
    row of each chunk. Without an encoder, or without vectors, search is lexical.
    """
    chunks, scopes = index.chunks(), queries.select("query_id", "docsets")
    lexical = search_index(index, queries.select("query_id", "question"), k=ASK_CANDIDATES, scopes=scopes)
    semantic = lexical.limit(0)
    if embed_fn is not None and chunks is not None and "embedding" in chunks.columns:
        asked = embed(queries, embed_fn, "query_id", "question", queries=True)
        semantic = cosine_topk(chunks.select("chunk_id", "docset", "embedding"), asked, k=ASK_CANDIDATES, scopes=scopes)
    symbols = chunks.select("chunk_id", "symbols") if chunks is not None else None
    fused = fuse(lexical, semantic, 32, ASK_CANDIDATES, chunks=symbols, wanted=queries.select("query_id", "symbols") if chunks is not None else None)
    own = fused.join(queries.select("query_id", "ask_id", "query_no", "result_count"), "query_id").filter(F.col("rank") <= F.col("result_count")).drop("result_count")
    return merged_queries(own, queries.select("ask_id", "result_count").distinct())


@dataclass
class Answers:
    """Tables by ask: outcomes (status, fixed answer, prompt, most_tokens, traces), and the sources that it may cite."""

    hits: DataFrame
    sources: DataFrame
    outcomes: DataFrame


def answer(index: Index, asks: DataFrame, available: list[str] | None = None, embed_fn: Callable[[list[str]], np.ndarray] | None = None, attachments: DataFrame | None = None, talk: Column | None = None) -> Answers:
    """What asks (ask_id, message, mode) get, within available packs or each ask's own docsets: small talk is searched for nothing."""
    marked = asks.withColumn("talk", planner.small_talk(F.col("message")) if talk is None else talk)
    plans = planner.plan(marked.filter(~F.col("talk")), available)
    # 16 rows an ask at most, read several times
    hits = stored(retrieve(index, plan_queries(plans, asks), embed_fn), "hits")
    chunks = index.chunks()
    shown = hits.join(chunks.select("chunk_id", *SHOWN), "chunk_id") if chunks is not None else hits.select("*", *[F.lit(None).cast("string").alias(c) for c in SHOWN])
    found = evidence.evidence(shown, attachments)
    return Answers(shown, evidence.sources(shown), evidence.answered(marked, hits, found, index.n > 0))
