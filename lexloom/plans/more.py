"""Further registered queries: ingest, packs, retrieval, plans, evidence, chats and streamed rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import docset_key
from lexloom.operators import evidence, index, ingest, packs, planner, tables
from lexloom.operators.lexical import bm25
from lexloom.operators.vectors import cosine_topk, fuse, merged_queries, open_sources, pair_cosine
from lexloom.plans import queries as base
from lexloom.plans.queries import BEST, BM25, SYMBOLS, bm25_sql
from lexloom.sources.tables import new_folder, table
from lexloom.streaming.answers import assembled, pack_states

#: Milliseconds at which undated chats count as made.
NOW = 1_706_659_200_000
AVAILABLE = ["python", "cpp", "local"]


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files, with an extension by language."""
    kind = F.when(F.col("lang") == "en", "md").when(F.col("lang") == "de", "txt").when(F.col("lang") == "fr", "HTML").otherwise("bin")
    return table(spark, d, "documents").select(F.col("doc_id").alias("slot"), F.concat("source", F.lit("/"), "doc_id", F.lit("."), kind).alias("path"), F.col("text").alias("content"))


def import_limited(spark: SparkSession, d: str) -> DataFrame:
    return ingest.import_limited(files(spark, d)).select("path", "library", F.octet_length("content").cast("long").alias("bytes"))


def asset_status(spark: SparkSession, d: str) -> DataFrame:
    """Documents against a catalog that has their characters for bytes, and wrong sums for every seventh."""
    docs = table(spark, d, "documents").filter("doc_id is not null and text is not null")
    catalog = docs.select(F.col("doc_id").cast("string").alias("name"), F.length("text").alias("bytes"), F.when(F.col("doc_id") % 7 == 0, "00").otherwise(F.upper(F.sha2("text", 256))).alias("sha256"))
    return packs_status(docs, catalog)


def packs_status(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    held = docs.filter("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"))
    return ingest.verify_assets(held, catalog)


def page_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))


def html_sections(spark: SparkSession, d: str) -> DataFrame:
    pages = ingest.parse_pages(page_files(spark, d), "https://docs.example", keep=("page_id",))
    rows = pages.select("page_id", "title", F.posexplode("sections").alias("section", "s"))
    return rows.select("page_id", F.col("section").cast("long").alias("section"), "title", "s.heading", "s.anchor", F.md5("s.text").alias("text_md5"))


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as plain-text pages, cut into chunks."""
    docs = table(spark, d, "documents").filter("doc_id is not null")
    rows = docs.select(F.coalesce("source", F.lit("none")).alias("docset"), F.lit("v1").alias("version"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    chunks = ingest.index_rows(ingest.chunk_pages(ingest.plain_pages(rows, "https://docs.example", keep=("docset", "version"))))
    return chunks.select("id", "stem", "section", "url", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def indexable(spark: SparkSession, d: str, text=None) -> DataFrame:
    """Documents as pages of one chunk, in stems by language."""
    return table(spark, d, "documents").select(docset_key(F.col("source")).alias("docset"), F.concat(F.lit("local-"), "lang").alias("stem"), F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("chunk_id"), (F.col("text") if text is None else text).alias("indexed"))


def index_search(spark: SparkSession, d: str) -> DataFrame:
    """The corpus written as an index by stem, and the questions asked of it."""
    folder = new_folder(spark, "index")
    index.write_index(indexable(spark, d), folder)
    return index.search_index(index.load_index(spark, folder), base.questions(spark, d))


def index_merged(spark: SparkSession, d: str) -> DataFrame:
    """All pages; then every third with other words, and one that isn't there yet; every seventh gone; a batch once more; all of it compacted."""
    folder, docs = new_folder(spark, "index"), indexable(spark, d)
    index.merge_pages(docs.filter("chunk_id % 5 <> 4"), docs, folder, "first")
    third = indexable(spark, d, F.concat(F.substring("text", 1, 400), F.lit(" "), F.reverse("text"))).filter("chunk_id % 3 = 0")
    new = docs.filter("chunk_id % 5 = 4 and chunk_id % 3 <> 0")
    for again in range(2):
        index.merge_pages(third.unionByName(new), third.unionByName(new), folder, "second")
    seventh = docs.filter("chunk_id % 7 = 0")
    index.merge_pages(seventh.limit(0), seventh, folder, "third")
    index.compact(spark, folder, most=1)
    return index.search_index(index.load_index(spark, folder), base.questions(spark, d))


def cosine_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return cosine_topk(v.filter("label in (1, 3)").select(F.col("vec_id").alias("chunk_id"), "embedding"), asked)


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the next one, and with nothing."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    none = F.array().cast("array<float>")
    return v.join(after, "vec_id").select("vec_id", F.round(pair_cosine(F.col("embedding"), F.col("after")), 6).alias("cosine"), pair_cosine(F.col("embedding"), none).alias("with_none"))


def hybrid_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Fused candidates, where a document of the source that the item's number names counts as an exact symbol."""
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.array("source").alias("symbols"))
    wanted = table(spark, d, "benchmark").select("item_id").distinct().join(docs, F.col("item_id") == F.col("doc_id")).select(F.col("item_id").alias("query_id"), F.array(F.upper("source")).alias("symbols"))
    return fuse(*base.ranked_lists(spark, d), chunks=chunks, wanted=wanted)


def hybrid_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two queries an ask, the whole text and its first 80 characters, merged by the best row of each chunk."""
    b = table(spark, d, "benchmark").select("item_id", "text").distinct()
    asked = b.select((F.col("item_id") * 2).alias("query_id"), F.col("text").alias("question")).union(b.select(F.col("item_id") * 2 + 1, F.substring("text", 1, 80)))
    hits = bm25(base.chunks(spark, d), asked, k=16).select(F.floor(F.col("query_id") / 2).alias("ask_id"), (F.col("query_id") % 2).alias("query_no"), "chunk_id", "score")
    return merged_queries(hits, b.select(F.col("item_id").alias("ask_id"), (F.col("item_id") % 13 + 4).alias("result_count")))


def sources_opened(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("docs://"), "source", F.lit("/"), "lang").alias("url"), F.col("doc_id").alias("slot"), F.col("n_chars"))
    odd = docs.select(F.concat("url", F.lit("#gone"))).union(docs.select(F.concat(F.lit("http://"), "url"))).toDF("url")
    return open_sources(docs.select("url").union(odd), docs).withColumn("n_chars", F.coalesce("n_chars", F.lit(-1).cast("long")))


def asks(spark: SparkSession, d: str) -> DataFrame:
    """Turns as asks, with a cue or a greeting by their number."""
    c = table(spark, d, "conversations").filter("conv_id is not null and turn is not null")
    more = F.when(F.col("turn") % 4 == 0, " about std::vector in Python").when(F.col("turn") % 4 == 1, " and CSS").otherwise("")
    hello = F.when(F.col("turn") % 5 == 3, "Hello,  there!").otherwise(F.concat(F.coalesce("text", F.lit("")), more))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ask_id"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), hello.alias("message"))


def joined(*names: str):
    return [F.array_join(n, "|").alias(n) for n in names]


def plan_asks(spark: SparkSession, d: str) -> DataFrame:
    return planner.plan(asks(spark, d), AVAILABLE).select("ask_id", *joined("queries", "docsets", "symbols"), "result_count")


def small_talk(spark: SparkSession, d: str) -> DataFrame:
    return asks(spark, d).select("ask_id", planner.small_talk(F.col("message")).alias("talk"))


def parsed_plans(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model by turn: plans whole and short, no object, no JSON, and objects of wrong types."""
    a = asks(spark, d)
    start = F.substring(F.regexp_replace("text", r'["\\\\\x00-\x1f]', " "), 1, 30)
    whole = F.concat(F.lit('<think>{"a": 1}</think>Plan: {"queries": ["'), start, F.lit('", " "], "docsets": ["python", "nope", "css", "css"], "symbols": [" a.b "], "resultCount": 99} done }'))
    forms = [whole, F.lit("no plan"), F.lit("{oops}"), F.lit('{"queries": "a"}'), F.lit('{"queries": []}'), F.lit('{"queries": [" "], "resultCount": 1}'), F.lit('{"queries": ["q"], "resultCount": -1}'), F.lit('{"queries": ["q", 7]}'), F.lit('{"docsets": ["css"]}')]
    answer = F.element_at(F.array(*forms), (F.col("ask_id") % len(forms) + 1).cast("int"))
    return planner.parse_plans(a.select("ask_id", F.col("text").alias("message"), answer.alias("answer"))).select("ask_id", "status", *joined("queries", "docsets", "symbols"), F.coalesce("result_count", F.lit(0)).alias("result_count"))


def hits_with_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("docset"), F.col("lang").alias("version"), F.lit("t<>").alias("title"), F.lit("").alias("section"), F.concat(F.lit("docs://"), "source").alias("url"), F.coalesce("text", F.lit("")).alias("text"))
    return base.bm25_topk(spark, d).filter("rank <= 6").join(docs, "chunk_id").withColumnRenamed("query_id", "ask_id")


def evidence_text(spark: SparkSession, d: str) -> DataFrame:
    return evidence.evidence(hits_with_text(spark, d)).select("ask_id", F.md5("evidence").alias("evidence_md5"), F.length("evidence").cast("long").alias("n_chars"))


def prompt_rows(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("ask_id"), F.col("text").alias("message"), F.when(F.col("item_id") % 2 == 0, "think").otherwise("fast").alias("mode"), (F.col("item_id") % 5 == 0).alias("talk")).distinct()
    return evidence.prompts(a, evidence.evidence(hits_with_text(spark, d).filter("ask_id % 4 <> 3"))).select("ask_id", F.md5("prompt").alias("prompt_md5"), F.col("most_tokens"))


def retrieval_trace(spark: SparkSession, d: str) -> DataFrame:
    return evidence.trace(base.rrf_hybrid(spark, d))


def citations_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Turns that cite S0 to S3 and S9 and have the sources S1 to S3."""
    own = F.array(*[F.struct(F.lit(f"S{k}").alias("id"), F.lit(f"docs://{k}").alias("url")) for k in (1, 2, 3)])
    a = asks(spark, d)
    return evidence.resolved_citations(a.select(F.col("ask_id").alias("message_id"), F.concat("text", F.lit(" [S"), (F.col("turn") % 4).cast("string"), F.lit("] ``` [S2] ``` and [S9]")).alias("content"), own.alias("sources")))


def pack_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources as listed packs, as manifests (with local ones by language), and as what has an index."""
    docs = table(spark, d, "documents").filter("source is not null")
    listed = docs.groupBy(F.col("source").alias("id")).agg(F.min("lang").alias("version")).withColumn("name", F.col("id"))
    counted = [F.max("lang").alias("version"), F.count(F.lit(1)).alias("page_count")]
    held = docs.groupBy(F.col("source").alias("id")).agg(*counted).withColumn("name", F.col("id"))
    local = docs.groupBy(F.concat(F.lit("local-"), "lang").alias("id")).agg(*counted).withColumn("name", F.upper(F.reverse("id")))
    indexed = docs.filter("lang <> 'es'").select(F.col("source").alias("id")).union(docs.filter("lang <> 'es'").select(F.concat(F.lit("local-"), "lang")))
    return listed, held.unionByName(local), indexed


def pack_inventory(spark: SparkSession, d: str) -> DataFrame:
    return packs.inventory(*pack_parts(spark, d))


def pack_totals(spark: SparkSession, d: str) -> DataFrame:
    return packs.totals(packs.inventory(*pack_parts(spark, d)))


def pack_filter(spark: SparkSession, d: str) -> DataFrame:
    return packs.docs_filter(packs.inventory(*pack_parts(spark, d)).withColumn("detail", F.col("state")), "  INST ").select("id")


def packs_to_install(spark: SparkSession, d: str) -> DataFrame:
    listed, held, indexed = pack_parts(spark, d)
    return packs.to_install(listed.select("id", "version"), held, indexed)


def pack_validation(spark: SparkSession, d: str) -> DataFrame:
    """Packs of documents by source, some with a wrong number of pages or schema version, or without a manifest."""
    docs = table(spark, d, "documents").filter("source is not null and doc_id is not null").select(F.col("source").alias("pack_key"), "doc_id")
    made = docs.groupBy("pack_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")).filter("low % 5 <> 4")
    return packs.pack_violations(made.select("pack_key", F.when(F.col("low") % 5 == 1, 2).otherwise(1).alias("schema_version"), F.when(F.col("low") % 5 == 2, F.col("n") + 1).otherwise(F.col("n")).alias("page_count")), docs)


def library_ids(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "pages").select(F.col("page_id").alias("slot"), F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("")).alias("name"))
    held = named.filter("slot % 10 = 0").select(F.concat(F.lit("local-"), packs.library_slug(F.col("name"))).alias("id"))
    return packs.library_ids(named, held)


def downloads_list(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "doc_id")
    items = docs.filter("doc_id % 3 = 0").select("id", F.lit("downloading").alias("state"))
    return packs.downloads_list(items, docs.select("id", F.when(F.col("lang") == "de", "docset").otherwise("model").alias("kind"), (F.col("doc_id") % 2 == 0).alias("present")))


def pack_progress(spark: SparkSession, d: str) -> DataFrame:
    """Events as progress rows of packs named by their users, of which those of even numbers are known."""
    e = table(spark, d, "events").filter("user_id is not null")
    k = F.col("event_id")
    rows = e.select(
        k.alias("seq"), F.concat(F.lit("u"), "user_id", F.when(k % 3 == 0, "-index").otherwise("")).alias("id"), F.when(k % 3 == 1, F.concat(F.lit("u"), "user_id")).alias("docset"), F.when(k % 7 == 0, "installed").when(k % 7 == 1, "error").otherwise("running").alias("state"), (k % 101).cast("double").alias("progress")
    )
    return pack_states(rows, e.filter("user_id % 2 = 0").select(F.concat(F.lit("u"), "user_id").alias("id")))


def answer_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Turns as streamed lines; every third is a mark, a blank or no JSON."""
    c = table(spark, d, "conversations").filter("conv_id is not null and turn is not null")
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    line = F.when(F.col("turn") % 3 == 2, F.when(F.col("turn") % 2 == 0, "data: [DONE]").otherwise("data: {oops")).otherwise(F.concat(F.lit("data: "), payload))
    return assembled(c.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), line.alias("line"))).select("chat_id", F.md5("answer").alias("answer_md5"), "status")


def stores(spark: SparkSession, d: str) -> DataFrame:
    """Chats as the JSON text of seven stores, with messages and chats that aren't as they should be."""
    c = table(spark, d, "conversations").filter("conv_id is not null and turn is not null")
    m = F.struct(F.concat("conv_id", F.lit("-"), "turn").alias("id"), "role", F.col("text").alias("content"), F.when(F.col("turn") < 6, F.col("turn")).alias("createdAt"))
    chats = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", m.alias("m")))).alias("ms"))  # a chat's turns
    chat = F.struct(F.when(F.col("conv_id") % 9 != 0, F.concat(F.lit("c"), "conv_id")).alias("id"), F.when(F.col("conv_id") % 2 == 0, "  ").otherwise("T").alias("title"), (F.col("conv_id") * 1000).alias("updatedAt"), F.transform("ms", lambda x: x["m"]).alias("messages"))
    return chats.groupBy((F.col("conv_id") % 7).alias("store_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", F.to_json(chat).alias("j")))), lambda x: x["j"]), ",").alias("j")).select("store_id", F.concat(F.lit('[7,null,"x",'), "j", F.lit("]")).alias("json"))


def chats_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Loaded, saved and loaded again: chats without a message go."""
    saved = tables.save_chats(tables.load_chats(stores(spark, d), NOW))
    got = tables.load_chats(saved, NOW)
    return got.select("store_id", F.col("slot").cast("long").alias("slot"), "id", "title", "created_at", "updated_at", F.size("messages").cast("long").alias("n_messages"))


def chats_renamed(spark: SparkSession, d: str) -> DataFrame:
    """Titles replaced by each chat's last text, and every fifth chat deleted."""
    chats = base.titles(spark, d).withColumnRenamed("conv_id", "id")
    c = table(spark, d, "conversations")
    typed = c.groupBy(F.col("conv_id").alias("id")).agg(F.max_by("text", "turn").alias("typed"))
    return tables.rename_chats(tables.delete_chats(chats, chats.filter("id % 5 = 0")), typed).select("id", "title")


MESSAGE = "case when turn % 5 = 3 then 'Hello,  there!' else coalesce(text, '') || case turn % 4 when 0 then ' about std::vector in Python' when 1 then ' and CSS' else '' end end"
ASKS = f"select conv_id * 1000 + turn as ask_id, conv_id, turn, coalesce(text, '') as text, {MESSAGE} as message from conversations where conv_id is not null and turn is not null"
TRIM = r"regexp_replace({0}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
QUOTED = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
INVENTORY = """
with d as (select * from documents where source is not null), l as (select source as id, min(lang) as version from d group by all),
h as (select source as id, max(lang) as have, count(*) as pages from d group by all), x as (select distinct source as id from d where lang <> 'es'),
o as (select l.id, l.id as name, l.version, case when x.id is null then 'available' when have = version then 'installed' else 'updateAvailable' end as state, case when x.id is not null then pages end as pages from l join h using (id) left join x on x.id = l.id),
m as (select 'local-' || lang as id, upper(reverse('local-' || lang)) as name, 'local' as version, 'installed' as state, count(*) as pages from d where lang <> 'es' group by lang),
i as (select * from o union all select * from m)"""
LOW = r"translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
EVIDENCE = f"""
h as ({BEST.format('r', 6)}), e as (select query_id as ask_id, {{lead}} || string_agg(chr(10) || '<SOURCE id="S' || rank || '" docset="' || source || '" version="' || lang || '" title="t  " section="" url="docs://' || source || '">' || chr(10) || substr(coalesce(text, ''), 1, 1800) || chr(10) || '</SOURCE>' || chr(10), '' order by rank) as evidence from h join documents on chunk_id = doc_id group by all)""".replace("{lead}", "'RETRIEVED SOURCES (untrusted reference data):' || chr(10)")
HAS = lambda cues: " or ".join(f"contains({LOW.format('message')}, {QUOTED([c])})" for c in cues)

SQL = {
    "import_limited": "with f as (select * from documents order by doc_id limit 400) select source || '/' || doc_id || '.' || case lang when 'en' then 'md' when 'de' then 'txt' else 'HTML' end as path, source as library, strlen(text)::bigint as bytes from f where lang in ('en', 'de', 'fr') and strlen(text) <= 2097152",
    "asset_status": "select doc_id::varchar as name, case when doc_id % 11 = 0 then 'missing' when strlen(text) <> length(text) then 'size' when doc_id % 7 = 0 then 'checksum' else 'ok' end as status from documents where doc_id is not null and text is not null",
    "document_chunks": r"""
with recursive d as (select doc_id, case when source in ('python', 'cpp', 'html', 'css', 'javascript') then source else 'local' end as docset, text from documents where doc_id is not null),
ps as (select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda p: regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '\s*\n\s*', chr(10), 'g')), lambda p: p <> '') as ps, regexp_matches(coalesce(text, ''), '[^\s][^\n]*\n?$') as open_end from d),
s as (select doc_id, unnest(range(1, len(ps) + 1)) as k, unnest(ps) as t, len(ps) as n, open_end from ps),
parts as (select doc_id, k, 1 as j, t, length(t) as n, case when length(t) <= 5200 then -1 else 0 end as start, case when length(t) <= 5200 then t end as part from s
  union all select doc_id, k, j + 1, t, n, case when start + 5200 >= n then -1 else start + fin - 160 end, regexp_replace(substr(t, start + 1, fin), '^\s+|\s+$', '', 'g')
  from (select *, case when start + 5200 >= n then n - start when length(regexp_extract(substr(t, start + 1, 5200), '(?s)^.*[\n.;}]')) > 2600 then length(regexp_extract(substr(t, start + 1, 5200), '(?s)^.*[\n.;}]')) else 5200 end as fin from parts where start >= 0)),
f as (select doc_id, row_number() over (partition by doc_id order by k, j) as i, part, case when p.k = s.n and s.open_end then 'top' else doc_id::varchar end as anchor from parts p join s using (doc_id, k) where part is not null),
pack as (select doc_id, 0::bigint as i, 0 as chunk, '' as held, 'top' as anchor, null::varchar as made, null::varchar as made_anchor from d
  union all select p.doc_id, f.i, chunk + is_full::int, case when is_full or held = '' then p.doc_id || chr(10) else held end || part || chr(10) || chr(10), case when is_full or held = '' then f.anchor else p.anchor end, case when is_full then held end, case when is_full then p.anchor end
  from (select pack.*, held <> '' and length(held) + length(pack.doc_id::varchar) + length(g.part) + 3 > 5200 as is_full from pack join f g on g.doc_id = pack.doc_id and g.i = pack.i + 1) p join f on f.doc_id = p.doc_id and f.i = p.i + 1),
done as (select doc_id, chunk - 1 as n, made as held, made_anchor as anchor from pack where made is not null union all select doc_id, chunk, held, anchor from pack where held <> '' qualify row_number() over (partition by doc_id order by i desc) = 1),
c as (select *, regexp_replace(held, '^\s+|\s+$', '', 'g') as t from done)
select docset || ':v1:' || doc_id || '.txt:' || n as id, docset as stem, doc_id::varchar as section, 'docs://' || docset || '/' || doc_id || '.txt#' || anchor as url, length(t) as n_chars, md5(t) as text_md5 from c join d using (doc_id)""",
    "index_search": base.SQL["bm25_topk"],
    "cosine_filtered": base.SQL["vector_topk"].replace("where q.vec_id % 100 = 0", "where q.vec_id % 100 = 0 and v.label in (1, 3)"),
    "cosine_pairs": "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine, 0.0::double as with_none from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "index_merged": base.bm25_sql("select item_id as query_id, text as question from benchmark", "select doc_id, case when doc_id % 3 = 0 then substr(text, 1, 400) || ' ' || reverse(text) else text end as text from documents where doc_id % 7 <> 0") + f"\n{BEST.format('r', 8)}",
    "hybrid_boosted": f"""{base.FUSED}, x as (select g.* exclude (score), round(score + case when lower(c.source) = lower(w.source) then 0.0125 else 0 end, 6) as score from g left join documents c on chunk_id = c.doc_id left join documents w on query_id = w.doc_id)
select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from x) where rank <= 8""",
    "hybrid_merged": f"""{bm25_sql("select item_id * 2 as query_id, text as question from benchmark union all select item_id * 2 + 1, substr(text, 1, 80) from benchmark")}, h as ({BEST.format('r', 16)}),
m as (select query_id // 2 as ask_id, chunk_id, max(score) as score from h group by all)
select ask_id, chunk_id, score, rank from (select *, row_number() over (partition by ask_id order by score desc, chunk_id)::int as rank from m) where rank <= least(16, ask_id % 13 + 4)""",
    "sources_opened": """
with c as (select 'docs://' || source || '/' || lang as url, max(doc_id) as slot, arg_max(n_chars, doc_id) as n_chars from documents group by all)
select url, 'found' as status, n_chars from c union all select url || '#gone', 'missing', -1 from c union all select 'http://' || url, 'no source', -1 from c""",
    "plan_asks": f"""
with a as ({ASKS}), s as (select *, {SYMBOLS.format('message')} as l, substr({TRIM.format('message')}, 1, 240) as q, list_concat(case when {HAS(planner.CUES["python"])} then ['python'] else [] end, case when {HAS(planner.CUES["cpp"])} then ['cpp'] else [] end) as two, ({" or ".join(HAS(planner.CUES[x]) for x in ("html", "css", "javascript"))}) as others from a),
t as (select *, list_filter(l, lambda x, i: list_position(l, x) = i)[1:12] as y from s)
select ask_id, array_to_string(list_filter([{TRIM.format('q')}, case when len(y) > 0 and not contains({LOW.format('q')}, {LOW.format('y[1]')}) then substr(y[1], 1, 240) else '' end], lambda x: x <> ''), '|') as queries,
array_to_string(list_sort(list_concat(case when len(two) = 0 and not others then ['python', 'cpp'] else two end, ['local'])), '|') as docsets, array_to_string(list_transform(y, lambda x: substr(x, 1, 100)), '|') as symbols, 8::int as result_count from t""",
    "small_talk": rf"""
with a as ({ASKS}), t as (select ask_id, {TRIM.format('message')} as m from a)
select ask_id, m = '' or (not ({" or ".join(f"contains(m, {QUOTED([c]) if c != chr(10) else 'chr(10)'})" for c in planner.TECHNICAL)}) and {TRIM.format(r"regexp_replace(regexp_replace(lower(m), '[!-&(-,./:-@\[-`{-~]', '', 'g'), '[\s\x0b]+', ' ', 'g')")} in ({QUOTED(planner.SMALL_TALK)})) as talk from t""",
    "parsed_plans": rf"""
with a as ({ASKS}), f as (select *, ask_id % 9 as f from a),
p as (select *, case f when 0 then [{TRIM.format("substr(regexp_replace(text, '[\"\\\x00-\x1f]', ' ', 'g'), 1, 30)")}] when 4 then [{TRIM.format("substr(text, 1, 240)")}] when 5 then [] end as qs from f)
select ask_id, case f when 1 then 'no object' when 0 then 'plan' when 4 then 'plan' when 5 then 'plan' else 'bad plan' end as status, array_to_string(list_filter(qs, lambda q: q <> ''), '|') as queries,
case f when 0 then 'css|local|python' when 4 then '' when 5 then '' end as docsets, case f when 0 then 'a.b' when 4 then '' when 5 then '' end as symbols, case f when 0 then 16 when 4 then 10 when 5 then 4 else 0 end::int as result_count from p""",
    "evidence_text": f"{BM25}, {EVIDENCE}\nselect ask_id, md5(evidence) as evidence_md5, length(evidence)::bigint as n_chars from e",
    "prompt_rows": f"""{BM25}, {EVIDENCE}
select distinct item_id as ask_id, md5(case when item_id % 5 = 0 then text when item_id % 4 <> 3 and evidence is not null then 'USER QUESTION:' || chr(10) || text || chr(10) || chr(10) || evidence end) as prompt_md5, case when item_id % 5 = 0 then 192 when item_id % 2 = 0 then 768 else 512 end::int as most_tokens from benchmark left join e on ask_id = item_id""",
    "retrieval_trace": f"with f as ({base.SQL['rrf_hybrid']}) select query_id, count(lexical_score) as lexical_hits, count(semantic_score) as semantic_hits from f group by all",
    "citations_resolved": f"with a as ({ASKS}), c as (select ask_id as message_id, unnest(['S' || (turn % 4), 'S9']) as source_id from a) select message_id, source_id, case when source_id in ('S1', 'S2', 'S3') then 'docs://' || substr(source_id, 2) end as url from c",
    "pack_inventory": f"{INVENTORY} select * from i",
    "pack_totals": f"{INVENTORY} select count(*) as installed, coalesce(sum(coalesce(pages, 0)), 0)::bigint as pages from i where state <> 'available'",
    "pack_filter": f"{INVENTORY} select id from i where contains(lower(name || ' ' || state || ' ' || version), 'inst')",
    "packs_to_install": f"{INVENTORY} select id, version from o where state <> 'installed'",
    "pack_validation": """
with p as (select source as pack_key, min(doc_id) % 5 as k from documents where source is not null and doc_id is not null group by all)
select pack_key, case k when 4 then 'no manifest' when 1 then 'schema version' else 'page count' end as violation from p where k in (1, 2, 4)""",
    "library_ids": r"""
with n as (select page_id as slot, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') as name from pages),
s as (select *, coalesce(nullif(array_to_string(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: x <> '')[1:6], '-'), ''), 'docs') as slug from n),
t as (select *, row_number() over (partition by slug order by slot) + case when slug in (select slug from s where slot % 10 = 0) then 1 else 0 end as k from s)
select slot, name, 'local-' || slug || case when k > 1 then '-' || k else '' end as id from t""",
    "downloads_list": "select doc_id::varchar as id, case when doc_id % 3 = 0 then 'downloading' else 'installed' end as state from documents where doc_id % 3 = 0 or (doc_id % 2 = 0 and coalesce(lang <> 'de', true))",
    "pack_progress": """
with m as (select event_id as seq, 'u' || user_id as docset, case event_id % 7 when 0 then 'installed' when 1 then 'error' else case when event_id % 3 = 0 then 'indexing' else 'downloading' end end as state from events where user_id is not null and user_id % 2 = 0 and event_id % 3 <> 2)
select docset, max(seq) as seq, arg_max(state, seq) as state, (max(seq) % 101)::double as progress from m group by docset""",
    "answer_assembly": "select conv_id as chat_id, md5(nullif(string_agg(text, '' order by turn) filter (turn % 3 <> 2), '')) as answer_md5, case when coalesce(string_agg(text, '' order by turn) filter (turn % 3 <> 2), '') = '' then 'empty' else 'whole' end as status from conversations where conv_id is not null and turn is not null group by conv_id",
    "chats_loaded": f"""
with c as (select conv_id, count(*) filter (role in ('user', 'assistant') and text is not null and turn < 6) as n from conversations where conv_id is not null and turn is not null group by all),
k as (select *, row_number() over (partition by conv_id % 7 order by conv_id) as slot from c where conv_id % 9 <> 0 and n > 0)
select conv_id % 7 as store_id, slot, 'c' || conv_id as id, case when conv_id % 2 = 0 then 'New chat' else 'T' end as title, {NOW}::bigint as created_at, conv_id * 1000 as updated_at, n as n_messages from k where slot <= 100""",
    "chats_renamed": rf"""
with t as ({base.SQL["titles"]}), l as (select conv_id, arg_max(text, turn) as typed from conversations group by all)
select conv_id as id, coalesce(nullif(substr(trim(regexp_replace(typed, '[\s\x0b]+', ' ', 'g')), 1, 80), ''), title) as title from t left join l using (conv_id) where conv_id % 5 <> 0""",
}

NAMES = (
    *(import_limited, asset_status, html_sections, document_chunks, index_search, index_merged, cosine_filtered, cosine_pairs, hybrid_boosted, hybrid_merged, sources_opened, plan_asks, small_talk, parsed_plans),
    *(evidence_text, prompt_rows, retrieval_trace, citations_resolved, pack_inventory, pack_totals, pack_filter, packs_to_install, pack_validation, library_ids, downloads_list, pack_progress),
    *(answer_assembly, chats_loaded, chats_renamed),
)
QUERIES = {f.__name__: f for f in NAMES}
