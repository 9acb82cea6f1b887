"""Benchmark decontamination in DataFrame functions only.

The normalised n-word windows of a benchmark form a hash set that is sent to
every task; each document's windows probe it, a probe that hits is verified
against the words themselves, and the words covered by hits decide whether a
document or only its spans go.

Defined cases: a null or empty text has no words and no hits; a benchmark
item of fewer than n words, but not none, is one window; an item without
words has no window; a null item_id counts for hits but can't be listed;
repeated rows of documents each give their own row; empty tables give no
hits, or no rows; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import ascii_lower, checkpointed, fresh, let

#: Characters between words, once A-Z are lower case.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def windows(ws: Column, length: Column | int) -> Column:
    """All runs of `length` words as (start from 1, length, hash)."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.when(
        F.size(ws) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(ws) - n + 1),
            lambda i: F.struct(i.alias("start"), n.alias("len"), F.xxhash64(F.slice(ws, i, n)).alias("h")),
        ),
    ).otherwise(F.array().cast("array<struct<start:int,len:int,h:bigint>>"))


def benchmark_windows(bench: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct windows of a benchmark: h, len, window (words), items (ids as strings)."""
    split = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    found = split.select("item", "ws", F.explode(windows(F.col("ws"), F.least(F.size("ws"), F.lit(n)))).alias("w"))
    return (
        found.select("item", "w.h", "w.len", F.slice("ws", F.col("w.start"), F.col("w.len")).alias("window"))
        .groupBy("h", "len", "window")
        .agg(F.collect_set("item").alias("items"))
    )


def find_hits(
    docs: DataFrame,
    bench: DataFrame,
    n: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_broadcast_windows: int = 2_000_000,
) -> DataFrame:
    """doc_id, text_hash, copies, n_words, hits (start, len) and items of each different (id, text).

    One pass over the documents probes every window's hash, without its words; a
    marker row for each document travels with the probes, so that documents
    without hits stay. The hashes are broadcast while their counted number allows
    it; more are joined by a shuffle. A second pass verifies the probes that hit
    against the words of their documents, each read once.
    """
    table = checkpointed(benchmark_windows(bench, n, item_col, item_text_col))
    # at most n + 1 numbers reach the driver
    sizes = {r["len"]: r["k"] for r in table.groupBy("len").agg(F.count(F.lit(1)).alias("k")).collect()}
    marker = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("h")))
    probes = let(words(F.col(text_col)), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.concat(marker, *[windows(ws, k) for k in sorted(sizes)]).alias("probes")))
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash.alias("text_hash"), probes.alias("s"))
    rows = rows.select("doc_id", "text_hash", "s.n_words", F.explode("s.probes").alias("p"))
    known = table.select(F.col("h").alias("bh")).distinct()
    if sum(sizes.values()) <= max_broadcast_windows:
        known = F.broadcast(known)  # a number each
    met = rows.join(known, F.col("p.h") == F.col("bh"), "left").filter((F.col("p.len") == 0) | F.col("bh").isNotNull())
    tried = met.groupBy("doc_id", "text_hash", "n_words").agg(
        F.sum(F.when(F.col("p.len") == 0, 1).otherwise(0)).alias("copies"),
        F.collect_set(F.when(F.col("p.len") > 0, F.col("p"))).alias("tried"),  # a document's own windows
    )
    tried = checkpointed(tried)

    maybe = tried.select("doc_id", "text_hash", F.explode("tried").alias("t")).join(table, (F.col("t.h") == F.col("h")) & (F.col("t.len") == F.col("len")))
    maybe = maybe.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("t.start", "len", "window", "items")).alias("maybe"))
    key, mark, list_ = fresh(docs, "tried_id", "tried_hash", "tried_list")
    asked = maybe.select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark), F.col("maybe").alias(list_))
    texts = docs.join(asked, docs[id_col].eqNullSafe(F.col(key)) & (text_hash == F.col(mark)))
    right = let(words(F.col(text_col)), lambda ws: F.filter(list_, lambda x: F.slice(ws, x["start"], x["len"]) == x["window"]))
    found = texts.select(F.col(key).alias("doc_id"), F.col(mark).alias("text_hash"), right.alias("right")).select(
        "doc_id",
        "text_hash",
        F.array_sort(F.array_distinct(F.transform("right", lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"))))).alias("hits"),
        F.array_distinct(F.flatten(F.transform("right", lambda x: x["items"]))).alias("items"),
    )
    found = found.dropDuplicates(["doc_id", "text_hash"]).toDF("found_doc", "found_text", "hits", "items")
    joined = tried.join(found, F.col("doc_id").eqNullSafe(F.col("found_doc")) & (F.col("text_hash") == F.col("found_text")), "left")
    none = F.array().cast("array<struct<start:int,len:int>>")
    return joined.select("doc_id", "text_hash", "copies", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_words(hits: Column) -> Column:
    """How many words the (start, len) hits cover, from hits in order of start."""
    return F.aggregate(
        hits,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - 1 - F.greatest(acc["last"], x["start"] - 1))).alias("n"),
            F.greatest(acc["last"], x["start"] + x["len"] - 1).alias("last"),
        ),
        lambda acc: acc["n"].cast("long"),
    )


def contamination(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """One row for each document: n_words, n_hit, n_items, items, hits, contaminated.

    contaminated: hit words are at least a twentieth of the document's words.
    """
    found = find_hits(docs, bench, **options)
    out = found.select(
        "doc_id",
        "text_hash",
        "copies",
        "n_words",
        hit_words(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("items"),
        "hits",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    # repeated rows were judged once
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def without_hits(text: Column, hits: Column) -> Column:
    """The text less each hit word and what follows it up to the next word."""

    def marked(ws: Column) -> Column:
        """Whether each word is hit: runs of words between the hits, which come in order of start."""
        run = lambda value, n: F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<boolean>>").alias("runs"))
        step = lambda acc, x: F.struct(
            F.greatest(acc["at"], x["start"] + x["len"] - 1).alias("at"),
            F.concat(acc["runs"], F.array(run(False, x["start"] - 1 - acc["at"]), run(True, x["start"] + x["len"] - 1 - F.greatest(acc["at"], x["start"] - 1)))).alias("runs"),
        )
        return F.aggregate(hits, start, step, lambda acc: F.concat(F.flatten(acc["runs"]), run(False, F.size(ws) - acc["at"])))

    def rebuilt(ws: Column, gaps: Column, hit: Column) -> Column:
        kept = F.transform(
            ws,
            lambda w, i: F.when(F.get(hit, i), F.lit("")).otherwise(F.concat(w, F.coalesce(F.get(gaps, i + 1), F.lit("")))),
        )
        return F.concat(F.coalesce(F.get(gaps, F.lit(0)), F.lit("")), F.array_join(kept, ""))

    found = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return let(found, lambda ws: let(F.split(text, WORD, -1), lambda gaps: let(marked(ws), lambda hit: rebuilt(ws, gaps, hit))))


def decontaminate(docs: DataFrame, bench: DataFrame, action: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with their own columns, without contaminated ones ("documents") or hit words ("spans")."""
    if action not in ("documents", "spans"):
        raise ValueError("action is 'documents' or 'spans'")
    found = contamination(docs, bench, id_col=id_col, text_col=text_col, **options)
    found = found.filter("contaminated" if action == "documents" else "n_hit > 0").dropDuplicates(["doc_id", "text_hash"])
    key, mark, spans = fresh(docs, "found_id", "found_hash", "found_hits")
    found = found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark), F.col("hits").alias(spans))
    same = docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(mark))
    if action == "documents":
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left")
    text = F.when(F.col(spans).isNotNull(), without_hits(F.col(text_col), F.col(spans))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, text).drop(key, mark, spans)
