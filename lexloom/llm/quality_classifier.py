"""A quality classifier: generalised additive model with pairwise interactions.

The model learns from a bounded sample of labelled rows (max_rows of them,
those with the smallest hash of their id) and is a few small tables, which
travel to the tasks; each task turns texts into features and adds up bins.

Defined cases: a null or empty text has zero features and gets a score like
any other; repeated rows get a row each; without labels every score is the
prior's 0.5; a document with several labels counts once for each; further
columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.boosting import Gam

N_FEATURES = 15


def features(text: str | None) -> list[float]:
    """Ratios of characters, words and lines of a text; nothing of its origin."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, n_words, n_lines = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    share = counts / max(counts.sum(), 1)
    at = lambda chars: float(sum(counts[ord(c)] for c in chars)) / n_words
    low = [w.lower() for w in words]
    threes = set(zip(low, low[1:], low[2:]))
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n_words,
        float(counts[65:91].sum()) / n,
        float(counts[48:58].sum()) / n,
        float(counts[128:].sum()) / n,
        at("#*$%&<>"),
        at("|"),
        at("!"),
        at(",;"),
        at(".?"),
        len(set(low)) / n_words,
        1 - len(threes) / max(len(low) - 2, 1) if len(low) > 2 else 0.0,
        1 - len(set(lines)) / n_lines if lines else 0.0,
        float(np.log1p(len(text) / n_lines)),
        float(-(share[share > 0] * np.log2(share[share > 0])).sum()),
    ]


def feature_matrix(texts: pd.Series) -> np.ndarray:
    return np.array([features(t if isinstance(t, str) else None) for t in texts], dtype=float).reshape(-1, N_FEATURES)


def in_fold(id_col: Column, mod: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Gam:
    """Fits the model to at most max_rows labelled rows, none of the held-out third."""
    rows = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("double").alias("y")).filter(F.col("i").isNotNull() & F.col("y").isNotNull() & ~in_fold(F.col("i"), 3, 1))
    rows = rows.orderBy(F.xxhash64("i"), "i", "y").limit(max_rows)
    get = F.pandas_udf(lambda s: pd.Series(list(feature_matrix(s))), "array<double>")
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(rows), "i").select("i", "y", get("t").alias("x"))
    got = sorted((r["i"], r["y"], tuple(r["x"])) for r in sample.limit(max_rows).collect())  # bounded by max_rows
    return Gam(np.array([r[2] for r in got], dtype=float).reshape(-1, N_FEATURES), np.array([r[1] for r in got], dtype=float))


def scored(docs: DataFrame, model: Gam, text_col: str = "text") -> Column:
    return F.pandas_udf(lambda s: pd.Series(model.score(feature_matrix(s))), "double")(F.col(text_col))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, id_col, text_col, **options)
    out = docs.select(F.col(id_col).alias("doc_id"), in_fold(F.col(id_col), 3, 1).alias("held_out"), scored(docs, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    return docs.filter(scored(docs, train(docs, labels, id_col, text_col, **options), text_col) >= threshold)
