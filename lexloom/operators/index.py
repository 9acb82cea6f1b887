"""The search index on disk: pages are merged in, segments are immutable, and a search reads the buckets of its terms.

A segment has these tables, by stem:

* chunks, on shelves by the hash of their page's path,
* postings, in buckets by the hash of their term and sorted by it; the bucket NO_TERM has
  a row for each chunk, whatever terms it has,
* terms: how many more chunks have a term than before the segment,
* gone: the pages that the segment replaces; earlier segments' rows of them are dead.

Statistics are sums over segments, so that none is computed again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import OFFICIAL
from lexloom.operators.lexical import asked_terms, best, term_rows
from lexloom.sources import snapshots
from lexloom.sources.files import children
from lexloom.sources.snapshots import escaped

#: Buckets of terms, shelves of pages, and the bucket of chunks' own rows.
BUCKETS, SHELVES, NO_TERM = 32, 16, -1
#: Asked terms that a scan is told by name; more are only joined.
MOST_NAMED = 200


def bucket_of(term: Column) -> Column:
    return F.when(term == "", NO_TERM).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))


def shelf_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(SHELVES)).cast("int")


@dataclass
class Index:
    """One version of an index: the live rows of its log bind it, so that later commits change nothing here."""

    spark: SparkSession
    folder: str
    version: int
    parts: list[Row]

    @property
    def stems(self) -> list[str]:
        """Official stems in their order, then the local ones."""
        found = {r["stem"] for r in self.parts}
        return [x for x in OFFICIAL if x in found] + sorted(found.difference(OFFICIAL))

    @property
    def n(self) -> int:
        return sum(r["n"] for r in self.parts)

    @property
    def average(self) -> float:
        return max(sum(r["total"] for r in self.parts) / self.n, 1.0) if self.n > 0 else 1.0

    def table(self, name: str, within: tuple[str, list[int]] | None = None, parts: list[Row] | None = None) -> DataFrame | None:
        """The rows of all segments with the version that added them; within names a partition column and the values to read. None where there are none."""
        parts, out = self.parts if parts is None else parts, []
        for segment in dict.fromkeys(r["segment"] for r in parts):
            own = [r for r in parts if r["segment"] == segment]
            top = f"{self.folder}/segments/{segment}/{name}"
            stems = set(children(self.spark, top))
            paths = [f"{top}/stem={escaped(r['stem'])}" for r in own if f"stem={r['stem']}" in stems]
            if paths:
                # with its type, a stem of digits stays text
                kinds = self.spark.read.parquet(paths[0]).schema.add("stem", "string")
                df = self.spark.read.schema(kinds).option("basePath", top).parquet(*paths)
                df = df.filter(F.col(within[0]).isin(within[1])) if within else df
                out.append(df.withColumn("_version", F.lit(own[0]["version"])))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out) if out else None

    def alive(self, rows: DataFrame) -> DataFrame:
        """rows (stem, path, _version) less those of pages that a later segment replaces."""
        dead = self.table("gone", parts=[r for r in self.parts if r["replaced"]]) if any(r["replaced"] for r in self.parts) else None
        if dead is None:
            return rows
        last = dead.groupBy("stem", "path").agg(F.max("_version").alias("_until"))
        return rows.join(last, ["stem", "path"], "left").filter("_until is null or _version >= _until").drop("_until")

    def chunks(self, shelves: list[int] | None = None) -> DataFrame | None:
        rows = self.table("chunks", ("shelf", shelves) if shelves is not None else None)
        return None if rows is None else self.alive(rows).drop("shelf", "_version")

    def postings(self, buckets: list[int]) -> DataFrame | None:
        rows = self.table("postings", ("bucket", buckets))
        return None if rows is None else self.alive(rows).drop("_version")

    def term_df(self, buckets: list[int]) -> DataFrame:
        return self.table("terms", ("bucket", buckets)).groupBy("term").agg(F.sum("df").alias("df"))


def load_index(spark: SparkSession, folder: str, version: int | None = None) -> Index:
    """All stems, official and local ones, as they are in a version, or now."""
    rows = snapshots.log_rows(spark, folder, version)
    return Index(spark, folder, snapshots.latest(rows), snapshots.live(rows))


def written(df: DataFrame, path: str, inner: str | None = None, sort: tuple[str, ...] = ()) -> None:
    """df by stem, and by inner; AQE splits what is large and joins what is small."""
    by = ["stem", *([inner] if inner else [])]
    df.hint("rebalance", *by).sortWithinPartitions(*by, *sort).write.partitionBy(*by).parquet(path, compression="zstd")


def merge_pages(rows: DataFrame, pages: DataFrame, folder: str, batch: str, replace: list[str] | None = None) -> bool:
    """Commit a segment: rows (stem, path, chunk_id, docset, indexed, ...) replace what the index has of pages (stem, path).

    Pages without a row are removed, and other pages stay. A batch that was
    committed before changes nothing, which gives False. With replace, the named
    stems hold only this segment afterwards, whatever pages they had.
    """
    spark = rows.sparkSession
    before = snapshots.log_rows(spark, folder)
    if snapshots.has_batch(before, batch):
        return False
    segment, version = snapshots.new_segment(), snapshots.latest(before) + 1
    top, old = f"{folder}/segments/{segment}", Index(spark, folder, version - 1, [r for r in snapshots.live(before) if r["stem"] not in (replace or [])])

    # each table comes from the one written before it
    written(rows.withColumn("shelf", shelf_of(F.col("path"))), f"{top}/chunks", "shelf", ("path",))
    made = spark.read.schema(f"{schema_of(rows)}, stem string, shelf int").parquet(f"{top}/chunks")
    terms = term_rows(made.select("stem", "docset", "path", "chunk_id", F.col("indexed").alias("text")), ("stem", "docset", "path"))
    written(terms.withColumn("bucket", bucket_of(F.col("term"))), f"{top}/postings", "bucket", ("term",))
    posts = spark.read.schema(f"{schema_of(terms)}, stem string, bucket int").parquet(f"{top}/postings")
    new = posts.select("stem", "bucket", "term", "tf", "len", F.lit(1).alias("sign"))

    touched, replaced, both = pages.select("stem", "path").distinct(), {}, new
    if old.parts:
        shelves = [r[0] for r in touched.select(shelf_of(F.col("path"))).distinct().collect()]  # at most SHELVES
        was = old.chunks(shelves) if shelves else None
        if was is not None:
            was = was.join(touched, ["stem", "path"], "left_semi").select("stem", "docset", "path", "chunk_id", F.col("indexed").alias("text"))
            were = term_rows(was, ("stem", "docset", "path"))
            replaced = {r["stem"]: r["n"] for r in was.groupBy("stem").agg(F.countDistinct("path").alias("n")).collect()}  # a row a stem
            both = new.unionByName(were.select("stem", bucket_of(F.col("term")).alias("bucket"), "term", "tf", "len", F.lit(-1).alias("sign"))) if replaced else new
            if replaced:
                written(was.select("stem", "path").distinct(), f"{top}/gone")
    df = F.sum(F.when(F.col("bucket") >= 0, F.col("sign")).otherwise(F.col("sign") * F.col("tf")))
    counts = both.groupBy("stem", "bucket", "term").agg(df.cast("bigint").alias("df"), F.sum(F.when(F.col("bucket") < 0, F.col("sign") * F.col("tf") * F.col("len"))).cast("bigint").alias("total"))
    written(counts.filter("df <> 0 or bucket < 0"), f"{top}/terms", "bucket", ("term",))
    sums = spark.read.schema("term string, df bigint, total bigint, stem string, bucket int").parquet(f"{top}/terms")
    sizes = sums.filter(F.col("bucket") == NO_TERM).groupBy("stem").agg(F.sum("df").alias("n"), F.sum("total").alias("total")).collect()  # a row a stem
    added = [(r["stem"], segment, r["n"], r["total"], replaced.get(r["stem"], 0)) for r in sizes]
    gone = [(r["stem"], r["segment"]) for r in snapshots.live(before) if r["stem"] in (replace or [])]
    snapshots.commit(spark, folder, batch, version, added, gone)
    return True


def schema_of(df: DataFrame) -> str:
    """The columns but for those that partition a table, so that an empty one can be read."""
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes if name not in ("stem", "shelf", "bucket"))


def write_index(rows: DataFrame, folder: str, stems: list[str] | None = None) -> None:
    """rows (stem, path, chunk_id, docset, indexed, ...) as the whole of their stems, or of those named; other stems stay.

    A named stem without rows is emptied. Readers see all of it or nothing, and the files of what was there before are deleted.
    """
    spark = rows.sparkSession
    stems = [r[0] for r in rows.select("stem").distinct().collect()] if stems is None else stems  # a row a stem
    merge_pages(rows, rows.select("stem", "path").limit(0), folder, f"whole-{snapshots.new_segment()}", replace=stems)
    snapshots.vacuum(spark, folder)


def remove_stem(spark: SparkSession, folder: str, stem: str) -> None:
    """A stem leaves the index, and its files are deleted; readers of earlier versions lose it too."""
    rows = snapshots.log_rows(spark, folder)
    gone = [(r["stem"], r["segment"]) for r in snapshots.live(rows) if r["stem"] == stem]
    if gone:
        snapshots.commit(spark, folder, f"remove-{snapshots.new_segment()}", snapshots.latest(rows) + 1, [], gone)
    snapshots.vacuum(spark, folder)


def compact(spark: SparkSession, folder: str, most: int = 8) -> list[str]:
    """Stems in more than `most` segments become one segment each, without dead rows; their names. Nothing is tokenised again."""
    rows = snapshots.log_rows(spark, folder)
    parts = snapshots.live(rows)
    stems = sorted({r["stem"] for r in parts if sum(x["stem"] == r["stem"] for x in parts) > most})
    own = [r for r in parts if r["stem"] in stems]
    if not own:
        return []
    old, segment = Index(spark, folder, snapshots.latest(rows), own), snapshots.new_segment()
    top = f"{folder}/segments/{segment}"
    written(old.alive(old.table("chunks")).drop("_version"), f"{top}/chunks", "shelf", ("path",))
    written(old.alive(old.table("postings")).drop("_version"), f"{top}/postings", "bucket", ("term",))
    summed = old.table("terms").groupBy("stem", "bucket", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    written(summed.filter("df <> 0 or bucket < 0"), f"{top}/terms", "bucket", ("term",))
    total = lambda stem, c: sum(r[c] for r in own if r["stem"] == stem)
    added = [(s, segment, total(s, "n"), total(s, "total"), 0) for s in stems]
    snapshots.commit(spark, folder, f"compact-{segment}", snapshots.latest(rows) + 1, added, [(r["stem"], r["segment"]) for r in own])
    return stems


def search_index(index: Index, questions: DataFrame, k: int = 8, docsets: list[str] | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best chunks for each question; statistics are those of all stems.

    docsets restricts all questions; scopes (query_id, docsets) each its own: an
    empty or missing list restricts nothing. Only the buckets of the asked terms are read.
    """
    spark, asked = index.spark, asked_terms(questions)
    buckets = [r[0] for r in asked.select(bucket_of(F.col("term"))).distinct().collect()]  # at most BUCKETS
    found = index.postings(buckets) if buckets and index.n > 0 else None
    kinds = dict(questions.dtypes)["query_id"]
    if found is None:
        known = index.table("chunks")
        kind = "string" if known is None else dict(known.dtypes)["chunk_id"]
        return spark.createDataFrame([], f"query_id {kinds}, chunk_id {kind}, score double, rank int")
    few = [r[0] for r in asked.select("term").distinct().limit(MOST_NAMED + 1).collect()]
    if len(few) <= MOST_NAMED:  # the scan skips row groups by the terms that it is told
        found = found.filter(F.col("term").isin(few))
    found = found.filter(F.col("docset").isin(docsets)) if docsets else found
    return best(found, index.term_df(buckets), index.n, index.average, asked, k, scopes=scopes)
