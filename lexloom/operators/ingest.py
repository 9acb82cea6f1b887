"""From files to pages with sections, and from pages to chunks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import parsing
from lexloom.functions.text import docset_key, let, packed_chunks, paragraphs, path_title, slug
from lexloom.sources.tables import stored

#: What is imported, by extension; the limits of one import.
EXTENSIONS = ("html", "htm", "md", "markdown", "txt", "rst", "text")
MOST_FILES, MOST_BYTES = 400, 2 * 1024 * 1024
#: Pages parsed before they are passed on.
PARSED = 256
SECTIONS = "array<struct<heading:string,anchor:string,text:string,code:array<string>>>"
PAGES = f"path string, title string, canonical_url string, symbols array<string>, sections {SECTIONS}"


def list_folders(spark: SparkSession, root: str, partitions: int = 32) -> DataFrame:
    """uri, path (relative, with slashes) and place (the names on its way, by which a walk through sorted folders orders files) of all files below root.

    Tasks list the folders of one level at a time; no name reaches the driver. Links are no files and no folders.
    """
    from pyarrow import fs

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = fs.FileSystem.from_uri(root)[0]
        local = isinstance(system, fs.LocalFileSystem)
        for pdf in batches:
            for uri, place in zip(pdf["uri"], pdf["place"]):
                found = [x for x in system.get_file_info(fs.FileSelector(uri)) if not (local and os.path.islink(x.path))]
                kind = {fs.FileType.File: True, fs.FileType.Directory: False}
                rows = [(x.path, [*place, x.base_name], kind[x.type]) for x in found if x.type in kind]
                yield pd.DataFrame(rows, columns=["uri", "place", "is_file"])

    columns = "uri string, place array<string>, is_file boolean"
    level, files = spark.createDataFrame([(fs.FileSystem.from_uri(root)[1], [])], "uri string, place array<string>"), None
    while True:
        found = stored(level.repartition(partitions, "uri").mapInPandas(listed, columns), "listing")
        files = found.filter("is_file") if files is None else files.union(found.filter("is_file"))
        level = found.filter("not is_file").select("uri", "place")
        if level.isEmpty():
            return files.select("uri", F.array_join(F.transform("place", lambda n: F.translate(n, "\\", "/")), "/").alias("path"), "place")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """list_folders of what can be imported: by extension, but for what lies in _sources and _static of the root."""
    kind = F.lower(F.regexp_extract(F.element_at("place", -1), r"^.+\.([^.]*)\z", 1))
    return list_folders(spark, root).filter(kind.isin(*EXTENSIONS) & ~F.startswith("path", F.lit("_sources/")) & ~F.startswith("path", F.lit("_static/")))


def read_tree(spark: SparkSession, root: str, partitions: int = 32) -> DataFrame:
    """path, place (the order of files) and content of a tree's files, read by the tasks; names that begin with _ count too."""
    from pyarrow import fs

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = fs.FileSystem.from_uri(root)[0]
        for pdf in batches:
            for uri, path, place in zip(pdf["uri"], pdf["path"], pdf["place"]):
                with system.open_input_stream(uri) as f:
                    yield pd.DataFrame({"path": [path], "place": [place], "content": [f.read().decode("utf-8", "replace")]})

    return list_tree(spark, root).repartition(partitions, "uri").mapInPandas(read, "path string, place array<string>, content string")


def import_limited(files: DataFrame, order: str = "slot") -> DataFrame:
    """The first MOST_FILES by order, of these those with a known extension and at most MOST_BYTES; library is the first part of the path."""
    first = files.orderBy(order).limit(MOST_FILES)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    fits = first.filter(kind.isin(*EXTENSIONS) & (F.octet_length("content") <= MOST_BYTES))
    return fits.withColumn("library", F.when(F.contains("path", F.lit("/")), F.split("path", "/")[0]).otherwise("Documentation"))


def slices(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The rows of batches, at most `most` at a time."""
    return (b.iloc[k : k + most] for b in batches for k in range(0, len(b), most))


def parse_pages(files: DataFrame, base: str, standalone: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages of files (path, content); pages without a section go. A path part .. is an error. keep: further columns."""
    safe = F.when(F.array_contains(F.split("path", "/"), ".."), F.raise_error(F.concat(F.lit("path leaves its folder: "), "path"))).otherwise(F.col("path"))
    rows = files.select(*keep, safe.alias("path"), F.coalesce("content", F.lit("")).alias("content"))
    types = dict(files.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a batch has thousands of pages: what is made of PARSED of them is passed on before the next
        for pdf in slices(batches, PARSED):
            made = [parsing.parse(p, f"{base.rstrip('/')}/{p}", c, base, standalone) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), pd.DataFrame(made, columns=["path", "title", "canonical_url", "symbols", "sections"])], axis=1)

    parsed = rows.mapInPandas(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), PAGES]))
    return parsed.filter(F.size("sections") > 0)


def plain_pages(files: DataFrame, base: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """parse_pages for files that are all plain text, with built-in functions only: a section for each paragraph."""
    safe = F.when(F.array_contains(F.split("path", "/"), ".."), F.raise_error(F.concat(F.lit("path leaves its folder: "), "path"))).otherwise(F.col("path"))
    title = path_title(F.col("path"))
    # what the end of the file closes is anchored at the top
    open_end = F.substring_index(F.regexp_replace(F.coalesce(F.col("content"), F.lit("")), r"\n\z", ""), "\n", -1).rlike(r"(?U)\S")
    made = lambda ps: F.transform(ps, lambda p, k: F.struct(title.alias("heading"), F.when(open_end & (k == F.size(ps) - 1), "top").otherwise(slug(title)).alias("anchor"), p.alias("text"), F.array().cast("array<string>").alias("code")))
    url = F.concat(F.lit(base.rstrip("/") + "/"), "path")
    rows = files.select(*keep, safe.alias("path"), title.alias("title"), url.alias("canonical_url"), F.array().cast("array<string>").alias("symbols"), let(paragraphs(F.col("content")), made).alias("sections"))
    return rows.filter(F.size("sections") > 0)


def chunk_pages(pages: DataFrame) -> DataFrame:
    """Chunks of pages (docset, version, and the columns of PAGES), in order within each page; the key holds the version."""
    rows = pages.select(docset_key(F.col("docset")).alias("docset"), "version", F.col("path").alias("page_path"), "title", "canonical_url", "symbols", F.posexplode(packed_chunks(F.col("sections"))).alias("n", "c"))
    key = F.concat_ws(":", "docset", "version", "page_path", "n")
    return rows.select(key.alias("id"), "docset", "version", "page_path", "title", F.col("c.label").alias("section"), "c.anchor", "canonical_url", "c.text", "symbols")


def index_stem(docset: Column | None = None, version: str = "version") -> Column:
    """The version of a local library, or else the docset."""
    docset = F.col("docset") if docset is None else docset
    return F.when(F.startswith(F.col(version), F.lit("local-")), F.col(version)).otherwise(docset)


def index_rows(chunks: DataFrame, scheme: str = "docs://") -> DataFrame:
    """Chunks as the index holds them: stem, url with the anchor, an empty embedding, and what is indexed as text."""
    stem = index_stem()
    named = chunks.withColumn("stem", stem).withColumn("url", F.concat(F.lit(scheme), stem, F.lit("/"), "page_path", F.lit("#"), "anchor"))
    return named.withColumn("embedding", F.array().cast("array<float>")).withColumn("indexed", F.concat_ws(" ", "title", "section", F.array_join("symbols", " "), "text"))


def verify_assets(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """name and status of catalog rows (name, bytes, sha256) against files (name, content): missing, size, checksum or ok."""
    found = files.select("name", F.octet_length("content").alias("length"), F.sha2("content", 256).alias("sum"))
    status = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").when(F.col("sum") != F.lower("sha256"), "checksum").otherwise("ok")
    return catalog.join(found, "name", "left").select("name", status.alias("status"))
