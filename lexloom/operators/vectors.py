"""Vectors: checks, exact cosine search, embedding jobs, and fusion of ranked tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import ascii_lower
from lexloom.operators.topk import rounded, top_k

#: Bytes of a text to embed, the words before a query, texts embedded at once, and the shortest retry.
MOST_BYTES, QUERY_WORDS, BATCH, LEAST_BYTES = 400, "Represent this sentence for searching relevant passages: ", 4, 128
#: What an exact symbol adds to a fused score, and candidates of a list.
SYMBOL_BOOST, CANDIDATES, ASK_CANDIDATES = 0.0125, 24, 48
#: Rows that a task holds before it keeps only the best.
MOST_FOUND = 500_000


def bounded_bytes(text: str, most: int) -> str:
    """The longest start of at most `most` bytes."""
    return text.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")


def passage(title: Column, section: Column, text: Column) -> Column:
    return F.concat_ws("\n", title, section, text)


def embed(rows: DataFrame, embed_fn: Callable[[list[str]], np.ndarray], id_col: str, text_col: str, queries: bool = False, most: int = MOST_BYTES) -> DataFrame:
    """id and embedding of each text; embed_fn gives a matrix for a list of texts.

    A batch that fails is tried text by text, each with ever fewer bytes, down to LEAST_BYTES.
    """
    kind = dict(rows.dtypes)[id_col]

    def alone(text: str) -> np.ndarray:
        size = most
        while True:
            try:
                return np.asarray(embed_fn([bounded_bytes(text, size)]))[0]
            except Exception:
                if size <= LEAST_BYTES:
                    raise
                size = max(size * 3 // 4, LEAST_BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [bounded_bytes((QUERY_WORDS if queries else "") + (t or ""), most) for t in pdf["t"]]
            out: list[np.ndarray] = []
            for k in range(0, len(texts), BATCH):
                some = texts[k : k + BATCH]
                try:
                    got = np.asarray(embed_fn(some))
                    if len(got) != len(some):
                        raise ValueError("a vector for each text")
                    out += list(got)
                except Exception:
                    out += [alone(t) for t in some]
            yield pd.DataFrame({"id": pdf["id"], "embedding": [x.astype(np.float32) for x in out]})

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)


def dimension(vectors: DataFrame) -> int | None:
    """The one length of all vectors that aren't empty; None if all are. Another length is an error."""
    sizes = [r[0] for r in vectors.select(F.size("embedding").alias("n")).filter("n > 0").distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and {sizes[1]} numbers")
    return sizes[0] if sizes else None


def normalised(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of length 1; null and empty ones become zero, and those near zero stay as they are."""
    zero = F.array_repeat(F.lit(0.0), dim)
    v = F.when(F.coalesce(F.size("embedding"), F.lit(0)) > 0, F.col("embedding").cast("array<double>")).otherwise(zero)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    eps = float(np.finfo(np.float32).eps)
    return vectors.withColumn("embedding", F.when(norm > eps, F.transform(v, lambda x: x / norm)).otherwise(v))


def pair_cosine(left: Column, right: Column) -> Column:
    """0 for vectors of unequal or no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(dot(left, left) * dot(right, right))
    return F.when((F.size(left) != F.size(right)) | (F.size(left) <= 0) | left.isNull() | right.isNull() | (norm == 0), F.lit(0.0)).otherwise(dot(left, right) / norm)


def blocks_of(rows: DataFrame, id_col: str, more: dict[str, str], block: int) -> tuple[DataFrame, int]:
    """Rows (id, embedding, more columns of these types) in blocks by hash, a row each: ids, matrix, and lists of the rest; and how many."""
    n = max(1, -(-rows.count() // block))
    kind = dict(rows.dtypes)[id_col]

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, kind="stable")
        matrix = np.stack(pdf["embedding"].to_list()).astype(float)
        return pd.DataFrame({"block": [key[0]], "ids": [pdf[id_col].to_list()], "matrix": [matrix.tobytes()]} | {c: [pdf[c].to_list()] for c in more})

    dealt = rows.select(F.pmod(F.xxhash64(id_col, "embedding"), F.lit(n)).cast("int").alias("block"), id_col, "embedding", *more)
    # a block has about `block` rows
    return dealt.groupBy("block").applyInPandas(packed, ", ".join(["block int", f"ids array<{kind}>", "matrix binary", *(f"{c} array<{k}>" for c, k in more.items())])), n


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 48, scopes: DataFrame | None = None, block: int = 4_096, asked_block: int = 512) -> DataFrame:
    """query_id, chunk_id, score, rank; null and empty vectors are zero and score 0, which takes a place too.

    Queries and vectors lie in blocks, and every block of queries meets every
    block of vectors in some task, as a matrix product; a task passes on its k
    best rows for a query. Neither side passes the driver. A repeated query asks
    once. With scopes (query_id, docsets), a query sees vectors of its docsets
    only (vectors then has docset); an empty or missing list restricts nothing.
    """
    spark, dim = vectors.sparkSession, dimension(vectors)
    wanted = dimension(queries)
    names = (dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"])
    kinds = f"query_id {names[0]}, chunk_id {names[1]}, score double"
    if dim is None or wanted is None:
        return top_k(spark.createDataFrame([], kinds), k)
    if wanted != dim:
        raise ValueError(f"queries of {wanted} numbers, vectors of {dim}")
    asked = normalised(queries.groupBy("query_id").agg(F.min("embedding").alias("embedding")), dim)
    held = normalised(vectors, dim)
    scoped = scopes is not None
    if scoped:
        asked = asked.join(scopes.groupBy("query_id").agg(F.min("docsets").alias("docsets")), "query_id", "left")
    right, n = blocks_of(held, "chunk_id", {"docset": "string"} if scoped else {}, block)
    left, _ = blocks_of(asked, "query_id", {"docsets": "array<string>"} if scoped else {}, asked_block)
    pairs = left.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumnsRenamed({"ids": "asked", "matrix": "questions"}).join(right, "block")

    def best(rows: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(rows).sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = [], 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                # before the cut, so that what ties in the result ties here
                s = rounded(np.frombuffer(r.questions).reshape(-1, dim) @ np.frombuffer(r.matrix).reshape(-1, dim).T)
                if scoped:
                    sets = np.array(r.docset, dtype=object)
                    s = np.stack([row if scope is None or not len(scope) else np.where(np.isin(sets, list(scope)), row, -np.inf) for row, scope in zip(s, r.docsets)])
                at_least = np.partition(s, -k, axis=1)[:, -k, None] if s.shape[1] > k else -2.0
                a, b = np.nonzero((s >= at_least) & (s > -np.inf))
                found.append(pd.DataFrame({"query_id": np.asarray(r.asked)[a], "chunk_id": np.asarray(r.ids)[b], "score": s[a, b]}))
                size += len(a)
                if size > MOST_FOUND:
                    found = [best(found)]
                    size = len(found[0])
                    if size > MOST_FOUND // 2:
                        yield found.pop()
                        size = 0
        if found:
            yield best(found)

    return top_k(pairs.mapInPandas(run, kinds), k)


def in_scope(chunks: DataFrame, docsets: list[str]) -> DataFrame:
    """Chunks of the named docsets; an empty list names all, unknown names none."""
    return chunks.filter(F.col("docset").isin(docsets)) if docsets else chunks


def resolved_scope(wanted: Column, allowed: Column) -> Column:
    """A plan's docsets within the allowed ones; an empty list restricts nothing, so that a plan with no allowed docset sees all."""
    return F.when(F.size(wanted) == 0, allowed).when(F.size(allowed) == 0, wanted).otherwise(F.array_intersect(wanted, allowed))


def symbol_boost(candidates: DataFrame, chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """candidates with SYMBOL_BOOST more where the chunk has one of the query's symbols, in any case of A-Z; chunks (chunk_id, symbols), wanted (query_id, symbols)."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), ascii_lower)
    rows = candidates.join(chunks.select("chunk_id", low(F.col("symbols")).alias("has")), "chunk_id", "left").join(wanted.select("query_id", low(F.col("symbols")).alias("want")), "query_id", "left")
    more = F.when(F.coalesce(F.arrays_overlap("has", "want"), F.lit(False)), SYMBOL_BOOST).otherwise(0.0)
    return rows.withColumn("score", F.col("score") + more).drop("has", "want")


def merged_queries(hits: DataFrame, plans: DataFrame) -> DataFrame:
    """ask_id, chunk_id, score, rank and what else hits has: of hits (ask_id, query_no, chunk_id, score, ...) the best row of each chunk (of the first query, on ties), the first result_count of each ask."""
    rest = [c for c in hits.columns if c not in ("ask_id", "chunk_id", "score", "query_no", "query_id", "rank")]
    best = hits.groupBy("ask_id", "chunk_id").agg(F.max(F.struct("score", -F.col("query_no"), *rest)).alias("b")).select("ask_id", "chunk_id", "b.score", *[f"b.{c}" for c in rest])
    ranked = top_k(best, 16, query="ask_id")
    return ranked.join(plans.select("ask_id", "result_count"), "ask_id").filter(F.col("rank") <= F.col("result_count")).drop("result_count")


def open_sources(urls: DataFrame, chunks: DataFrame, scheme: str = "docs://") -> DataFrame:
    """url, status and the last chunk (by slot) of each url asked for: found, missing, or no source for another scheme."""
    rest = [c for c in chunks.columns if c not in ("url", "slot")]
    last = chunks.groupBy("url").agg(F.max(F.struct("slot", *rest)).alias("last"))
    status = F.when(~F.startswith("url", F.lit(scheme)), "no source").when(F.col("last").isNull(), "missing").otherwise("found")
    got = urls.select("url").distinct().join(last, "url", "left").withColumn("status", status)
    return got.select("url", "status", *[F.when(F.col("status") == "found", F.col(f"last.{c}")).alias(c) for c in rest])


def fused_candidates(lexical: DataFrame, semantic: DataFrame, candidates: int = CANDIDATES, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked tables, not cut yet; both raw scores stay, null where a list lacks the row."""
    part = lambda df, kind: df.filter(F.col("rank") <= candidates).select("query_id", "chunk_id", "rank", "score", F.lit(kind).alias("kind"))
    both = part(lexical, "lexical").unionByName(part(semantic, "semantic"))
    raw = [F.max(F.when(F.col("kind") == x, F.col("score"))).alias(f"{x}_score") for x in ("lexical", "semantic")]
    return both.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), *raw)


def fuse(lexical: DataFrame, semantic: DataFrame, k: int = 8, candidates: int = CANDIDATES, constant: int = 60, chunks: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """The k best fused rows, 32 at most; with chunks and wanted, exact symbols raise candidates before the cut."""
    rows = fused_candidates(lexical, semantic, candidates, constant)
    return top_k(rows if wanted is None else symbol_boost(rows, chunks, wanted), max(1, min(32, k)))
