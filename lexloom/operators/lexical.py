"""BM25 over a table of chunks, for a table of questions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators.topk import rounded, top_k
from lexloom.sources.tables import stored

#: Chunks that a task tokenises, chunks scored at once, blocks of them in a task, and questions and terms of a matrix.
TOKENISED, BLOCK, BLOCKS_EACH, ASKED, TERMS = 4_096, 2_048, 4, 256, 4_096


def doc_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.size(tokens(F.col("text"))).alias("len"))


def postings(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, term, tf and the chunk's length, with the columns to keep; counted before the shuffle."""
    return term_rows(chunks, keep).filter("term <> ''")


def exploded(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each token of a chunk, and one with an empty term for the chunk itself; len is the chunk's number of tokens.

    Texts are dealt by their chunk, as many to a task at 1 GB as at 100: what counts a chunk's tokens shuffles nothing more.
    """
    n = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() // TOKENISED))
    words = chunks.select("chunk_id", *keep, "text").repartition(n, "chunk_id").select("chunk_id", *keep, tokens(F.coalesce("text", F.lit(""))).alias("ts"))
    return words.select("chunk_id", *keep, F.size("ts").alias("len"), F.explode(F.concat(F.array(F.lit("")), "ts")).alias("term"))


def term_rows(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, the columns to keep, term, len and tf; the rows of the empty term stand for the chunks."""
    return exploded(chunks, keep).groupBy("chunk_id", *keep, "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def term_df(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def asked_terms(questions: DataFrame) -> DataFrame:
    """The different terms of each question; a repeated question asks once."""
    return questions.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).distinct()


def small(df: DataFrame, bounded_by: DataFrame, most: int = 500_000) -> DataFrame:
    """df, to be broadcast if bounded_by, which has as many rows at least and is cheaper to count, has at most `most`."""
    return F.broadcast(df) if bounded_by.limit(most + 1).count() <= most else df


def weights(asked: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """query_id, term and idf of asked_terms that some chunk has, from term_df and the number of chunks."""
    weight = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return asked.join(df, "term").select("query_id", "term", weight.alias("idf"))


def best(post: DataFrame, df: DataFrame, n: int, average: float, asked: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, scopes: DataFrame | None = None, most: int = 500_000) -> DataFrame:
    """query_id, chunk_id, BM25 score and rank of the k best chunks, from postings, term_df, the number and average length of chunks, and asked_terms.

    Up to `most` asked terms are told to the tasks: postings lie in blocks of
    chunks, and a block passes on its k best chunks for a question, so that no
    table of all questions with all their chunks is made. More are joined by term.
    scopes (query_id, docsets) lets each question see postings of its docsets
    only; an empty or missing list restricts nothing.
    """
    weighed = weights(asked, df, n)
    own = None if scopes is None else scopes.groupBy("query_id").agg(F.min("docsets").alias("docsets"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / average))
    if asked.limit(most + 1).count() > most:
        hits = post.join(weighed if own is None else weighed.join(own, "query_id", "left"), "term")
        if own is not None:
            hits = hits.filter((F.coalesce(F.size("docsets"), F.lit(-1)) <= 0) | F.array_contains("docsets", F.col("docset")))
        return top_k(hits.groupBy("query_id", "chunk_id").agg(F.sum(F.col("idf") * part).alias("score")).filter("score > 0"), k)

    told = weighed if own is None else weighed.join(own, "query_id", "left")
    told = told.toArrow()  # `most` rows at most
    terms, queries = told["term"].combine_chunks().dictionary_encode(), told["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    known = pa.table({"term": terms.dictionary, "number": pa.array(np.arange(len(terms.dictionary), dtype=np.int32))})
    spark, blocks = post.sparkSession, max(1, -(-n // BLOCK))
    scope: list = [None] * len(queries.dictionary)
    if own is not None:
        for at, names in dict(zip(queries.indices.to_pylist(), told["docsets"].to_pylist())).items():
            scope[at] = names
    kind = ", ".join(f"{x} {dict(df.dtypes)[x]}" for x, df in (("query_id", asked), ("chunk_id", post))) + ", score double"
    if not len(known):
        return top_k(spark.createDataFrame([], kind), k)
    scorer = block_scorer(queries.indices.to_numpy(), queries.dictionary, terms.indices.to_numpy(), told["idf"].to_numpy(), scope if own is not None else None, k)
    rows = post.join(F.broadcast(spark.createDataFrame(known)), "term")
    rows = rows.select(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("block"), "chunk_id", "number", part.alias("part"), *([] if own is None else ["docset"]))
    # a task has about BLOCKS_EACH blocks, a block about BLOCK chunks
    dealt = rows.repartition(max(1, min(blocks, spark.sparkContext.defaultParallelism), blocks // BLOCKS_EACH), "block")
    return top_k(dealt.groupBy("block").applyInArrow(scorer, kind), k)


def block_scorer(query: np.ndarray, queries: pa.Array, term: np.ndarray, idf: np.ndarray, scope: list | None, k: int) -> Callable[[pa.Table], pa.Table]:
    """Scores a block of postings (chunk_id, number, part, docset) for asked terms (query's and term's number, idf): products of questions by terms and terms by chunks."""
    order = np.argsort(query, kind="stable")
    query, term, idf = query[order], term[order], idf[order]

    def product(first: int, unit: np.ndarray, units: int, number: np.ndarray, part: np.ndarray) -> np.ndarray:
        some = slice(*np.searchsorted(query, [first, first + ASKED]))
        own, column = np.unique(term[some], return_inverse=True)
        s = np.zeros((min(ASKED, len(queries) - first), units))
        for low in range(0, len(own), TERMS):
            cut = own[low : low + TERMS]
            w = np.zeros((len(s), len(cut)))
            asked = (column >= low) & (column < low + len(cut))
            w[query[some][asked] - first, column[asked] - low] = idf[some][asked]
            at = np.minimum(np.searchsorted(cut, number), len(cut) - 1)
            has = cut[at] == number
            s += w @ np.bincount(unit[has] * len(cut) + at[has], weights=part[has], minlength=units * len(cut)).reshape(units, -1).T
        return s

    def run(rows: pa.Table) -> pa.Table:
        found = rows["chunk_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        # in the order of ties
        turn = pc.sort_indices(found.dictionary, null_placement="at_start").to_numpy()
        chunks, place = found.dictionary.take(pa.array(turn)), np.empty(len(turn), dtype=np.int64)
        place[turn] = np.arange(len(turn))
        chunk, units = place[found.indices.to_numpy()], len(chunks)
        number, part = rows["number"].to_numpy(), rows["part"].to_numpy()
        if scope is not None:  # a chunk's postings of each docset by themselves
            named = rows["docset"].combine_chunks().dictionary_encode(null_encoding="encode")
            docset = named.indices.to_numpy()
        asked, got, scores = [], [], []
        for first in range(0, len(queries), ASKED):
            if scope is None:
                s = product(first, chunk, units, number, part)
            else:
                s = np.zeros((min(ASKED, len(queries) - first), units))
                for at, name in enumerate(named.dictionary.to_pylist()):
                    own, sees = docset == at, [not names or (name is not None and name in names) for names in scope[first : first + ASKED]]
                    s[sees] += product(first, chunk[own], units, number[own], part[own])[sees]
            r = np.where(s > 0, rounded(s), -np.inf)
            top = np.argsort(-r, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(r, top, axis=1)
            a, c = np.nonzero(value > -np.inf)
            asked.append(a + first)
            got.append(top[a, c])
            scores.append(value[a, c])
        a, c = np.concatenate(asked), np.concatenate(got)
        return pa.table({"query_id": queries.take(pa.array(a)), "chunk_id": chunks.take(pa.array(c)), "score": np.concatenate(scores)})

    return run


def bm25(chunks: DataFrame, questions: DataFrame, k: int = 8, k1: float = 1.2, b: float = 0.75, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best chunks, or of the k best that allowed (chunk_id) has.

    Statistics are those of all chunks. The chunks are tokenised once: the counts
    of terms that some question has are written, and all else is read from them.
    To ask more than once, write an index (index.write_index) and search that.
    """
    asked = asked_terms(questions)
    wanted = asked.select("term").distinct().union(asked.sparkSession.createDataFrame([("",)], "term string"))
    kept = exploded(chunks).join(small(wanted, asked), "term", "left_semi")
    rows = stored(kept.groupBy("term", "chunk_id", "len").agg(F.count(F.lit(1)).alias("tf")), "terms")
    own = rows.filter("term = ''").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.sum(F.col("tf") * F.col("len")).alias("total")).first()  # one row
    counted = rows.filter("term <> ''")
    df = term_df(counted)
    if allowed is not None:  # after the statistics
        counted = counted.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return best(counted, df, own["n"], max(own["total"] / own["n"], 1.0) if own["n"] else 1.0, asked, k, k1, b)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n_docs, sum_terms."""
    return doc_lengths(chunks).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.coalesce("len", F.lit(0))), F.lit(0)).cast("long").alias("sum_terms"))
