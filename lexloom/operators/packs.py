"""Packs of pages, inventories and downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import ascii_lower, docset_key
from lexloom.operators.index import remove_stem
from lexloom.sources.files import delete
from lexloom.sources.snapshots import escaped
from lexloom.sources.tables import stored

#: Version, address, licence and attribution of the packs that can be installed, and of local ones.
MDN = ("2026-08-12", "https://developer.mozilla.org/en-US/docs", "https://creativecommons.org/licenses/by-sa/2.5/", "MDN content by Mozilla Contributors")
METADATA = [
    ("python", "3.14.7", "https://docs.python.org/3", "https://docs.python.org/3/license.html", "© Python Software Foundation"),
    ("cpp", "2025-02-09", "https://en.cppreference.com/w", "https://en.cppreference.com/w/Cppreference:Copyright/CC-BY-SA", "cppreference.com contributors"),
    *((key, *MDN) for key in ("html", "css", "javascript")),
    ("local", "local", "docs://local", "", "Imported by the user"),
]
EXPECTED = [row[:4] for row in METADATA if row[0] != "local"]
#: The only schema version that is read.
SCHEMA_VERSION = 1


def expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPECTED, "id string, version string, base_url string, license_url string")


def write_pack(packs: DataFrame, pages: DataFrame, folder: str) -> None:
    """packs (pack_key, schema_version, page_count, ...) and pages (pack_key, ...) as tables by pack; other packs in the folder stay."""
    for name, df in (("packs", packs), ("pages", pages)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("pack_key").parquet(f"{folder}/{name}")


def pack_violations(packs: DataFrame, pages: DataFrame) -> DataFrame:
    """pack_key and what is wrong: schema version, number of pages, or pages without a manifest."""
    counted = pages.groupBy("pack_key").agg(F.count(F.lit(1)).alias("counted"))
    both = packs.select("pack_key", "schema_version", "page_count").join(counted, "pack_key", "full")
    wrong = (
        F.when(F.col("schema_version").isNull(), "no manifest").when(F.col("schema_version") != SCHEMA_VERSION, "schema version").when(F.col("page_count") != F.coalesce("counted", F.lit(0)), "page count")
    )
    return both.select("pack_key", wrong.alias("violation")).filter("violation is not null")


def read_pack(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(packs, pages) of a folder; a violation is an error."""
    packs, pages = (spark.read.parquet(f"{folder}/{x}") for x in ("packs", "pages"))
    first = pack_violations(packs, pages).first()
    if first:
        raise ValueError(f"pack {first['pack_key']}: {first['violation']}")
    return packs, pages


def remove_pack(spark: SparkSession, folder: str, stem: str, downloads: DataFrame) -> DataFrame:
    """A pack leaves the packs and the index of a folder, with its files; downloads without its rows (its id and its index pass)."""
    for name in ("packs", "pages"):
        delete(spark, f"{folder}/{name}/pack_key={escaped(stem)}")
    remove_stem(spark, f"{folder}/index", stem)
    return downloads.filter(~F.col("id").isin(stem, f"{stem}-index"))


def to_install(requested: DataFrame, installed: DataFrame, indexed: DataFrame) -> DataFrame:
    """Requested packs (id, version) less those that are installed in that version and have an index."""
    ready = installed.select("id", "version").join(indexed.select("id").distinct(), "id", "left_semi")
    return requested.join(ready, ["id", "version"], "left_anti")


def inventory(listed: DataFrame, manifests: DataFrame, indexed: DataFrame) -> DataFrame:
    """id, name, version, state and pages: the listed packs (id, name, version), then the local ones by name; manifests has id, name, version, page_count."""
    ready = manifests.join(indexed.select("id").distinct(), "id", "left_semi")
    own = ready.select("id", F.col("version").alias("have"), F.col("page_count").alias("pages"))
    state = F.when(F.col("have").isNull(), "available").when(F.col("have") == F.col("version"), "installed").otherwise("updateAvailable")
    official = listed.join(own, "id", "left").select("id", "name", "version", state.alias("state"), "pages", F.lit(0).alias("local"))
    mine = ready.filter(F.startswith("id", F.lit("local-"))).select("id", "name", F.lit("local").alias("version"), F.lit("installed").alias("state"), F.col("page_count").alias("pages"), F.lit(1).alias("local"))
    return official.unionByName(mine).orderBy("local", F.when(F.col("local") == 1, F.lower("name")), "id").drop("local")


def totals(packs: DataFrame) -> DataFrame:
    has = packs.filter(F.col("state").isin("installed", "updateAvailable"))
    return has.agg(F.count(F.lit(1)).alias("installed"), F.coalesce(F.sum(F.coalesce("pages", F.lit(0))), F.lit(0)).cast("long").alias("pages"))


def docs_filter(packs: DataFrame, typed: str) -> DataFrame:
    """Packs whose name, detail or version holds what was typed."""
    return packs.filter(F.contains(F.lower(F.concat_ws(" ", "name", "detail", "version")), F.lit(typed.strip().lower())))


def library_slug(name):
    """Lower-case runs of ASCII letters and digits, at most six, by dashes; docs if there is none."""
    parts = F.slice(F.array_remove(F.split(F.regexp_replace(ascii_lower(name), "[^a-z0-9]+", "-"), "-"), ""), 1, 6)
    return F.coalesce(F.nullif(F.array_join(parts, "-"), F.lit("")), F.lit("docs"))


def library_ids(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new (slot, name) with an id local-<slug>, -2, -3 ... where others have it before: those of existing, and earlier slots.

    Free numbers of a slug go to its rows in their order; existing ids that end
    in a number count for the slug before it. The k-th free number of a slug is k
    and as many more as numbers are taken before it: those with fewer than k free
    ones below them, which a window over both counts. Where rows of different
    slugs would get one id, the earliest slot keeps it and the rest are dealt again.
    """
    named = stored(new.withColumn("slug", library_slug(F.col("name"))).withColumn("turn", F.row_number().over(Window.partitionBy("slug").orderBy("slot"))), "libraries")
    tail = F.regexp_extract("id", r"-([1-9][0-9]{0,8})\z", 1)
    number = F.when(tail != "", tail.cast("bigint"))
    bare = existing.filter(F.startswith("id", F.lit("local-"))).select(F.expr("substring(id, 7)").alias("slug"), F.lit(1).cast("bigint").alias("n"))
    numbered = existing.filter(F.startswith("id", F.lit("local-")) & (number > 1)).select(F.expr(r"regexp_replace(substring(id, 7), '-[0-9]+\\z', '')").alias("slug"), number.alias("n"))
    taken = bare.union(numbered).distinct()
    while True:
        order = Window.partitionBy("slug").orderBy("n")
        held = taken.select("slug", (F.col("n") - F.row_number().over(order)).alias("key"), F.lit(1).alias("held"), F.lit(None).cast("bigint").alias("turn"))
        both = named.select("slug", F.col("turn").cast("bigint").alias("key"), F.lit(0).alias("held"), F.col("turn").cast("bigint").alias("turn")).union(held)
        before = F.sum("held").over(Window.partitionBy("slug").orderBy("key", "held").rowsBetween(Window.unboundedPreceding, 0))
        found = both.withColumn("n", F.col("key") + before).filter("turn is not null").select("slug", "turn", "n")
        named_id = F.concat(F.lit("local-"), "slug", F.when(F.col("n") > 1, F.concat(F.lit("-"), "n")).otherwise(""))
        out = stored(named.join(found, ["slug", "turn"]).withColumn("id", named_id), "libraries")
        first = out.groupBy("id").agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        lost = out.join(first, "id").filter("slot <> first").select("slug", "n")
        if lost.isEmpty():
            return out.select("slot", "name", "id")
        taken = stored(taken.union(lost).distinct(), "libraries")


def downloads_list(items: DataFrame, assets: DataFrame) -> DataFrame:
    """items (id, state), then installed assets (id, kind, present) that aren't listed yet; docsets are no assets of this list."""
    more = assets.filter((F.col("kind") != "docset") & F.col("present")).join(items.select("id"), "id", "left_anti")
    return items.select("id", "state").unionByName(more.select("id", F.lit("installed").alias("state")))


def mirrored(progress: DataFrame) -> DataFrame:
    """progress (id, state, docset, ...) with the docset and state that each row shows on its pack; rows of no pack go."""
    index_pass = F.endswith("id", F.lit("-index"))
    pack = F.coalesce("docset", F.when(index_pass, F.regexp_replace("id", "-index$", "")))
    state = F.when(F.col("state").isin("installed", "error"), F.col("state")).when(index_pass, "indexing").otherwise("downloading")
    return progress.withColumn("docset", pack).withColumn("state", state).filter("docset is not null")


def selected_bytes(packs: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: packs and bytes of the official packs (id, compressed_bytes) that are selected (id)."""
    own = packs.filter(~F.startswith("id", F.lit("local-")) & (F.col("id") != "local")).join(selected.select("id").distinct(), "id", "left_semi")
    return own.agg(F.count(F.lit(1)).alias("packs"), F.coalesce(F.sum("compressed_bytes"), F.lit(0)).cast("long").alias("bytes"))


def pack_metadata(packs: DataFrame) -> DataFrame:
    """packs (id, ...) with version, base_url, license_url and attribution; every key that is no official pack's has those of a local one."""
    known = packs.sparkSession.createDataFrame(METADATA, "key string, version string, base_url string, license_url string, attribution string")
    return packs.withColumn("key", docset_key(F.col("id"))).join(F.broadcast(known), "key").drop("key")  # six rows
