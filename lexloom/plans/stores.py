"""Registered queries over pack files, pack metadata, chats and progress, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import docset_named
from lexloom.operators import packfiles, packs, tables
from lexloom.sources.tables import table

#: The hour that recent chats are seen from, and names that packs are called by.
NOW_HOURS, NAMES = 200, ("Python", "C++", "JS", "css", "Local", "java", "local-notes")


def pack_files(spark: SparkSession, d: str) -> DataFrame:
    """Packs of documents by source and language as lines of JSON; by their first id some have another entry, too many bytes, no manifest, a manifest or a page that isn't one, another schema or number of pages."""
    docs = table(spark, d, "documents").filter("doc_id is not null and source is not null and lang is not null").withColumn("pack_key", F.concat("source", F.lit("-"), "lang"))
    made = docs.groupBy("pack_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"))
    k = F.col("low") % 8
    names = F.array_compact(F.array(F.lit("pages.jsonl"), F.when(k != 3, "manifest.json"), F.when(k == 1, "notes.txt")))
    entries = made.select("pack_key", F.explode(names).alias("name"), F.when((k == 2) & (F.col("pack_key") != ""), 3_000_000_000).otherwise(1000).cast("bigint").alias("length"))
    license = F.struct(F.lit("MIT").alias("name"), F.lit("").alias("url"), F.lit("a").alias("attribution"))
    text = [F.lit(x).alias(x) for x in ("id", "name", "version", "sourceUrl", "sourceRevision", "createdAt", "locale")]
    whole = F.to_json(F.struct(F.when(k == 6, 2).otherwise(1).alias("schemaVersion"), *text, (F.col("n") + F.when(k == 7, 1).otherwise(0)).alias("pageCount"), license.alias("license")))
    manifests = made.filter(k != 3).select("pack_key", F.when(k == 4, F.regexp_replace(whole, '"locale"', '"place"')).otherwise(whole).alias("text"))
    section = F.struct(F.lit("h").alias("heading"), F.lit("top").alias("anchor"), F.col("text"))
    page = F.to_json(F.struct(F.lit("p").alias("path"), F.lit("t").alias("title"), F.lit("u").alias("canonicalUrl"), F.array(section).alias("sections")))
    one_bad = docs.join(made, "pack_key").select("pack_key", F.col("doc_id").alias("line"), F.when((k == 5) & (F.col("doc_id") == F.col("low")), F.regexp_replace(page, '^."path"', '{"road"')).otherwise(page).alias("text"))
    return packfiles.violations(entries, packfiles.parsed_manifests(manifests), packfiles.parsed_pages(one_bad.filter("text is not null")))


def pack_selection(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of selected packs, with local ones among the packs and the selected."""
    docs = table(spark, d, "documents").filter("source is not null and lang is not null")
    held = docs.groupBy(F.col("source").alias("id")).agg(F.sum("n_chars").alias("compressed_bytes")).union(docs.groupBy(F.concat(F.lit("local-"), "lang")).agg(F.sum("n_chars")))
    selected = docs.filter("doc_id % 5 = 0").select(F.col("source").alias("id")).union(docs.select(F.concat(F.lit("local-"), "lang")))
    return packs.selected_bytes(held, selected)


def named(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    return table(spark, d, "documents").filter("doc_id is not null").select("doc_id", name.alias("name"))


def docset_names(spark: SparkSession, d: str) -> DataFrame:
    return named(spark, d).select("doc_id", docset_named(F.col("name")).alias("docset"))


def pack_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Packs by name, as keys, with what is known of them."""
    return packs.pack_metadata(named(spark, d).groupBy(F.lower("name").alias("id")).agg(F.count(F.lit(1)).alias("n")))


def chat_groups(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as chats that were last updated at the hour of their number."""
    chats = table(spark, d, "conversations").filter("conv_id is not null").select(F.col("conv_id").alias("id")).distinct()
    hour = 3_600_000
    found = tables.recent_chats(chats.withColumn("updated_at", F.col("id") * hour), F.timestamp_millis(F.lit(NOW_HOURS * hour)))
    return found.select("id", "bucket")


SQL = {
    "pack_files": """
with p as (select source || '-' || lang as pack_key, min(doc_id) % 8 as k from documents where doc_id is not null and source is not null and lang is not null group by all)
select pack_key, case k when 1 then 'unexpected entry' when 2 then 'entry too large' when 3 then 'no manifest' when 4 then 'bad manifest' when 5 then 'bad page' when 6 then 'schema version' else 'page count' end as violation from p where k > 0""",
    "pack_selection": "with d as (select * from documents where source is not null and lang is not null) select count(distinct source) as packs, coalesce(sum(n_chars), 0)::bigint as bytes from d where source in (select source from d where doc_id % 5 = 0)",
    "docset_names": "select doc_id, case doc_id % 7 when 0 then 'python' when 1 then 'cpp' when 2 then 'javascript' when 3 then 'css' when 4 then 'local' end as docset from documents where doc_id is not null",
    "pack_metadata": f"""
with n as (select ['python', 'c++', 'js', 'css', 'local', 'java', 'local-notes'][doc_id % 7 + 1] as id, count(*) as n from documents where doc_id is not null group by all),
m(key, version, base_url, license_url, attribution) as (values {", ".join("(" + ", ".join("'" + x + "'" for x in row) + ")" for row in packs.METADATA)})
select id, n, version, base_url, license_url, attribution from n join m on key = case when id in ('python', 'css') then id else 'local' end""",
    "chat_groups": f"with c as (select distinct conv_id as id, {NOW_HOURS} - conv_id as age from conversations where conv_id is not null) select id, case when age < 24 then 'today' when age < 168 then 'week' else 'older' end as bucket from c",
}
QUERIES = {f.__name__: f for f in (pack_files, pack_selection, docset_names, pack_metadata, chat_groups)}
