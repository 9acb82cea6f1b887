"""Packs as files: a manifest and pages as lines of JSON, checked before they are read.

A pack is a folder with manifest.json and pages.jsonl (or compressed ones that Spark
reads, as pages.jsonl.gz). Sizes come from the listing; a file that is too large is
never opened. Spark lists no empty files, so that these are no entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.packs import SCHEMA_VERSION

#: The entries of a pack, and the most bytes of each.
MANIFEST, PAGES, MOST_MANIFEST, MOST_PAGES = "manifest.json", "pages.jsonl", 1024 * 1024, 2 * 1024 * 1024 * 1024
#: Keys of JSON that a manifest, its license, a page and a section must have, those with a default, and their types.
TEXT, TEXTS, WHOLE = "STRING", "ARRAY<STRING>", "BIGINT"
MANIFEST_KEYS = {"schemaVersion": WHOLE, "id": TEXT, "name": TEXT, "version": TEXT, "sourceUrl": TEXT, "sourceRevision": TEXT, "createdAt": TEXT, "locale": TEXT, "pageCount": WHOLE, "license.name": TEXT, "license.url": TEXT, "license.attribution": TEXT}
PAGE_KEYS, PAGE_DEFAULTS = {"path": TEXT, "title": TEXT, "canonicalUrl": TEXT}, {"symbols": TEXTS}
SECTION_KEYS, SECTION_DEFAULTS = {"heading": TEXT, "anchor": TEXT, "text": TEXT}, {"code": TEXTS}


def fits(v: Column, key: str, kind: str, needed: bool = True) -> Column:
    """Whether the value at a key is of a type; lists may be empty but hold no null, and whole numbers aren't negative."""
    part = F.try_variant_get(v, f"$.{key}", "variant")
    right = F.schema_of_variant(part) == kind
    if kind == TEXTS:
        right = F.schema_of_variant(part).isin(TEXTS, "ARRAY<VOID>") & ~F.exists(F.try_variant_get(v, f"$.{key}", "array<string>"), lambda x: x.isNull())
    if kind == WHOLE:
        right = right & (F.try_variant_get(v, f"$.{key}", "bigint") >= 0)
    right = F.coalesce(right, F.lit(False))
    return right if needed else part.isNull() | right


def all_fit(v: Column, keys: dict[str, str], defaults: dict[str, str] | None = None) -> Column:
    return reduce(lambda a, b: a & b, [*(fits(v, k, t) for k, t in keys.items()), *(fits(v, k, t, False) for k, t in (defaults or {}).items())])


def parsed_pages(lines: DataFrame) -> DataFrame:
    """pack_key, line (its number) and page of lines (pack_key, line, text) that aren't blank; a line that is no page has null."""
    v = F.try_parse_json("text")
    sections = F.try_variant_get(F.col("v"), "$.sections", "array<variant>")
    right = all_fit(F.col("v"), PAGE_KEYS, PAGE_DEFAULTS) & F.coalesce(F.forall(sections, lambda s: all_fit(s, SECTION_KEYS, SECTION_DEFAULTS)), F.lit(False))
    get = lambda v, key, kind="string": F.try_variant_get(v, f"$.{key}", kind)
    texts = lambda v, key: F.coalesce(get(v, key, "array<string>"), F.array().cast("array<string>"))
    made = F.transform(sections, lambda s: F.struct(get(s, "heading").alias("heading"), get(s, "anchor").alias("anchor"), get(s, "text").alias("text"), texts(s, "code").alias("code")))
    p = F.col("v")
    page = F.struct(get(p, "path").alias("path"), get(p, "title").alias("title"), get(p, "canonicalUrl").alias("canonical_url"), texts(p, "symbols").alias("symbols"), made.alias("sections"))
    rows = lines.filter(F.col("text").rlike(r"(?U)\S")).withColumn("v", v)
    return rows.select("pack_key", "line", F.when(right, page).alias("page"))


def parsed_manifests(manifests: DataFrame) -> DataFrame:
    """pack_key, right (whether it is a manifest), schema_version and page_count of manifests (pack_key, text)."""
    rows = manifests.withColumn("v", F.try_parse_json("text"))
    v = F.col("v")
    offer = F.try_variant_get(v, "$.license.sourceOfferUrl", "variant")
    right = all_fit(v, MANIFEST_KEYS) & (offer.isNull() | F.is_variant_null(offer) | fits(v, "license.sourceOfferUrl", TEXT))
    return rows.select("pack_key", right.alias("right"), F.try_variant_get(v, "$.schemaVersion", "bigint").alias("schema_version"), F.try_variant_get(v, "$.pageCount", "bigint").alias("page_count"))


def violations(entries: DataFrame, manifests: DataFrame, pages: DataFrame) -> DataFrame:
    """pack_key and the first thing that is wrong with a pack; packs without a violation don't occur.

    entries (pack_key, name, length), manifests as of parsed_manifests, pages as
    of parsed_pages. In this order: an unexpected entry, an entry too large, no
    manifest, a bad manifest, a bad page, the schema version, the page count.
    """
    name, too_large = F.col("name"), (F.col("name") == MANIFEST) & (F.col("length") > MOST_MANIFEST) | F.startswith("name", F.lit(PAGES)) & (F.col("length") > MOST_PAGES)
    odd = (name != MANIFEST) & ~F.regexp_like("name", F.lit(rf"^{PAGES.replace('.', '[.]')}([.](gz|zst|bz2))?\z"))
    listed = entries.groupBy("pack_key").agg(F.bool_or(odd).alias("odd"), F.bool_or(too_large).alias("large"), F.bool_or(name == MANIFEST).alias("has"))
    counted = pages.groupBy("pack_key").agg(F.count(F.lit(1)).alias("pages"), F.bool_or(F.col("page").isNull()).alias("bad"))
    rows = listed.join(manifests, "pack_key", "left").join(counted, "pack_key", "left")
    wrong = F.when(F.col("odd"), "unexpected entry").when(F.col("large"), "entry too large").when(~F.col("has"), "no manifest").when(~F.coalesce("right", F.lit(False)), "bad manifest").when(F.coalesce("bad", F.lit(False)), "bad page")
    wrong = wrong.when(F.col("schema_version") != SCHEMA_VERSION, "schema version").when(F.col("page_count") != F.coalesce("pages", F.lit(0)), "page count")
    return rows.select("pack_key", wrong.alias("violation")).filter("violation is not null")


def read_packs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pages, violations) of the packs in a folder's folders: pages (pack_key, line, page's columns) of packs without a violation."""
    parts = F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/")
    key, name = F.element_at(parts, -2).alias("pack_key"), F.element_at(parts, -1).alias("name")
    entries = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(key, name, "length")
    fine = entries.filter(((F.col("name") == MANIFEST) & (F.col("length") <= MOST_MANIFEST)) | (F.startswith("name", F.lit(PAGES)) & (F.col("length") <= MOST_PAGES))).select("pack_key", "name")
    # a row for each file
    read = lambda names, **options: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(folder, **options).select(key, name, F.col("value").alias("text")).join(fine, ["pack_key", "name"], "left_semi").drop("name")
    manifests = parsed_manifests(read(MANIFEST, wholetext=True))
    pages = parsed_pages(read(f"{PAGES}*").withColumn("line", F.monotonically_increasing_id()))
    wrong = violations(entries, manifests, pages)
    return pages.join(wrong, "pack_key", "left_anti").select("pack_key", "line", "page.*"), wrong
