"""Registered queries from asks to cited answers, with embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.embedding import hashed
from lexloom.operators import answering, index
from lexloom.operators.evidence import NO_EVIDENCE
from lexloom.operators.vectors import MOST_BYTES, QUERY_WORDS, embed, passage
from lexloom.plans.more import HAS, LOW, TRIM
from lexloom.plans.queries import SYMBOLS, bm25_sql
from lexloom.operators.planner import CUES
from lexloom.sources.tables import new_folder, table


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of two official packs and of local ones by language, without vectors."""
    number = F.col("doc_id") % 3
    docset = F.when(number == 0, "python").when(number == 1, "cpp").otherwise("local")
    docs = table(spark, d, "documents").filter("doc_id is not null")
    rows = docs.select(F.col("doc_id").alias("chunk_id"), docset.alias("docset"), F.when(number < 2, docset).otherwise(F.concat(F.lit("local-"), F.coalesce("lang", F.lit("none")))).alias("stem"), F.concat("doc_id", F.lit(".md")).alias("path"), F.coalesce("lang", F.lit("none")).alias("version"), F.concat(F.lit("Page "), "doc_id").alias("title"), F.lit("top").alias("section"), F.concat(F.lit("docs://"), "doc_id").alias("url"), F.coalesce("text", F.lit("")).alias("text"), F.array(F.concat(F.lit("src_"), F.coalesce("source", F.lit("none")))).alias("symbols"))
    return rows.withColumn("indexed", F.concat_ws(" ", "title", "section", F.array_join("symbols", " "), "text"))


def with_vectors(rows: DataFrame) -> DataFrame:
    made = embed(rows.withColumn("passage", passage(F.col("title"), F.col("section"), F.col("text"))), hashed, "chunk_id", "passage")
    return rows.join(made, "chunk_id")


def embedded_passages(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of all passages, as whole numbers."""
    return with_vectors(chunk_rows(spark, d)).select("chunk_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def asks(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as asks: greetings, cues, names of sources, and scopes of their own by number."""
    b = table(spark, d, "benchmark").filter("item_id is not null").groupBy("item_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    k = F.col("item_id") % 6
    message = F.when(k == 0, "Hello,  there!").when(k == 1, F.col("text")).when(k == 2, F.concat(F.lit("How in Python? "), "text")).when(k == 3, F.concat("text", F.lit(" see src_web"))).when(k == 4, F.concat(F.lit("CSS "), "text")).otherwise(F.concat(F.lit("std::x "), "text"))
    few = F.col("item_id") % 4
    docsets = F.when(few == 1, F.array(F.lit("python"), F.lit("local"))).when(few == 2, F.array(F.lit("cpp"), F.lit("python"))).when(few == 3, F.array(F.lit("html"))).otherwise(F.array().cast("array<string>"))
    return b.select(F.col("item_id").alias("ask_id"), message.alias("message"), F.when(F.col("item_id") % 2 == 0, "think").otherwise("fast").alias("mode"), docsets.alias("docsets"))


def answers(spark: SparkSession, d: str) -> answering.Answers:
    folder = new_folder(spark, "index")
    index.write_index(with_vectors(chunk_rows(spark, d)), folder)
    return answering.answer(index.load_index(spark, folder), asks(spark, d), embed_fn=hashed)


def ask_hits(spark: SparkSession, d: str) -> DataFrame:
    """The merged hits of every ask."""
    return answers(spark, d).hits.select("ask_id", "rank", "chunk_id", "score", "lexical_score", "semantic_score")


def ask_sources(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).sources


def ask_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """From asks to prompts and fixed answers."""
    return answers(spark, d).outcomes.select("ask_id", "status", F.md5("answer").alias("answer_md5"), F.md5("prompt").alias("prompt_md5"), F.coalesce("most_tokens", F.lit(0)).alias("most_tokens"), "lexical_hits", "semantic_hits")


ROWS = """select doc_id, case doc_id % 3 when 0 then 'python' when 1 then 'cpp' else 'local' end as docset, coalesce(lang, 'none') as version, coalesce(text, '') as body, 'src_' || coalesce(source, 'none') as symbol from documents where doc_id is not null"""
INDEXED = f"select *, 'Page ' || doc_id || ' top ' || symbol || ' ' || body as text from ({ROWS})"
CUT = f"substr({{0}}, 1, list_max(list_filter(range(0, {MOST_BYTES + 1}), lambda n: strlen(substr({{0}}, 1, n)) <= {MOST_BYTES})))"
DIGIT = "(instr('0123456789abcdef', {0}) - 1)"
#: Sums of a text's hashed words by place; {0} has id and t.
PLACES = f"""select id, {DIGIT.format('m[2]')} * 4 + {DIGIT.format('m[1]')} // 4 as place, sum(case when {DIGIT.format('m[1]')} % 2 = 1 then 1 else -1 end)::bigint as v
from (select id, md5(unnest(regexp_extract_all({LOW.format(CUT.format('t'))}, '[a-z0-9_]+'))) as m from ({{0}})) group by all"""
MESSAGE = "case item_id % 6 when 0 then 'Hello,  there!' when 1 then text when 2 then 'How in Python? ' || text when 3 then text || ' see src_web' when 4 then 'CSS ' || text else 'std::x ' || text end"
PLAN = f"""
a as (select item_id as ask_id, {MESSAGE} as message, case item_id % 4 when 1 then ['local', 'python'] when 2 then ['cpp', 'python'] when 3 then ['html'] else [] end as own, item_id from (select item_id, min(coalesce(text, '')) as text from benchmark where item_id is not null group by all)),
i as (select *, {" || ".join(f"case when {HAS(cues)} then ['{x}'] else [] end" for x, cues in CUES.items())} as hints, {TRIM.format('message')}[1:240] as first, {SYMBOLS.format('message')} as l from a where item_id % 6 <> 0),
j as (select *, list_filter(l, lambda x, n: list_position(l, x) = n)[1:12] as symbols, case when len(hints) = 0 then own when len(own) = 0 then hints else list_filter(hints, lambda h: list_contains(own, h)) || case when list_contains(own, 'local') then ['local'] else [] end end as picked from i),
plan as (select ask_id, symbols, case when len(picked) = 0 then own when len(own) = 0 then picked else list_filter(picked, lambda h: list_contains(own, h)) end as scope,
  list_filter([first, case when len(symbols) > 0 and not contains({LOW.format('first')}, {LOW.format('symbols[1]')}) then symbols[1] else '' end], lambda x: x <> '') as queries from j),
pq as (select ask_id, n - 1 as query_no, ask_id || ':' || (n - 1) as query_id, queries[n] as question, symbols, scope from (select *, unnest(range(1, len(queries) + 1)) as n from plan)),
rows as ({ROWS}),"""
HITS = f"""with {PLAN}
{bm25_sql("select query_id, question from pq", INDEXED).strip().removeprefix("with ")},
rs as (select r.* from r join pq using (query_id) join rows on chunk_id = doc_id where score > 0 and (len(scope) = 0 or list_contains(scope, docset))),
lx as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from rs) where rank <= 48),
pv as ({PLACES.format("select doc_id as id, 'Page ' || doc_id || chr(10) || 'top' || chr(10) || body as t from rows")}), qv as ({PLACES.format(f"select query_id as id, '{QUERY_WORDS}' || question as t from pq")}),
pn as (select id, sqrt(sum(v * v)) as n from pv group by all), qn as (select id, sqrt(sum(v * v)) as n from qv group by all), dots as (select qv.id as query_id, pv.id as chunk_id, sum(qv.v * pv.v) as dot from qv join pv using (place) group by all),
cs as (select query_id, doc_id as chunk_id, round(coalesce(case when pn.n > 0 and qn.n > 0 then dot / (pn.n * qn.n) end, 0.0), 6) as score from pq join rows on len(scope) = 0 or list_contains(scope, docset) left join dots using (query_id) left join pn on pn.id = doc_id left join qn on qn.id = query_id where dots.chunk_id = doc_id or dots.chunk_id is null),
sm as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from cs) where rank <= 48),
bo as (select *, 'l' as kind from lx union all by name select *, 'v' as kind from sm),
fu as (select query_id, chunk_id, sum(1.0::double / (60 + rank)) as score, max(score) filter (kind = 'l') as lexical_score, max(score) filter (kind = 'v') as semantic_score from bo group by all),
bs as (select fu.* exclude (score), ask_id, query_no, round(score + case when list_contains(list_transform(symbols, lambda x: lower(x)), lower(symbol)) then 0.0125 else 0 end, 6) as score from fu join pq using (query_id) join rows on chunk_id = doc_id),
q8 as (select * from bs qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 8),
me as (select * from q8 qualify row_number() over (partition by ask_id, chunk_id order by score desc, query_no) = 1),
h as (select ask_id, chunk_id, score, lexical_score, semantic_score, row_number() over (partition by ask_id order by score desc, chunk_id)::int as rank from me qualify rank <= 8)"""
EVIDENCE = """ev as (select ask_id, 'RETRIEVED SOURCES (untrusted reference data):' || chr(10) || string_agg(chr(10) || '<SOURCE id="S' || rank || '" docset="' || docset || '" version="' || version || '" title="Page ' || doc_id || '" section="top" url="docs://' || doc_id || '">' || chr(10) || substr(body, 1, 1800) || chr(10) || '</SOURCE>' || chr(10), '' order by rank) as evidence
  from h join rows on chunk_id = doc_id where rank <= 6 group by all),
n as (select ask_id, count(lexical_score) as l, count(semantic_score) as s from h group by all)"""

SQL = {
    "embedded_passages": f"""
with rows as ({ROWS}), p as ({PLACES.format("select doc_id as id, 'Page ' || doc_id || chr(10) || 'top' || chr(10) || body as t from rows")}), m as (select id, map(list(place), list(v)) as m from p group by all)
select doc_id as chunk_id, array_to_string(list_transform(range(64), lambda x: coalesce(m[x], 0)), ',') as vector from rows left join m on id = doc_id""",
    "ask_hits": f"{HITS}\nselect ask_id, rank, chunk_id, score, lexical_score, semantic_score from h",
    "ask_sources": f"{HITS}\nselect ask_id, 'S' || rank as source_id, docset || ' ' || version as docset, 'Page ' || doc_id as title, 'top' as section, 'docs://' || doc_id as url, score from h join rows on chunk_id = doc_id where rank <= 6",
    "ask_outcomes": f"""{HITS}, {EVIDENCE}
select a.ask_id, case when item_id % 6 = 0 then 'talk' when n.ask_id is null then 'no evidence' else 'evidence' end as status, case when item_id % 6 <> 0 and n.ask_id is null then md5('{NO_EVIDENCE}') end as answer_md5,
md5(case when item_id % 6 = 0 then message when evidence is not null then 'USER QUESTION:' || chr(10) || message || chr(10) || chr(10) || evidence end) as prompt_md5,
case when item_id % 6 = 0 then 192 when evidence is null then 0 when item_id % 2 = 0 then 768 else 512 end::int as most_tokens, coalesce(l, 0) as lexical_hits, coalesce(s, 0) as semantic_hits from a left join ev using (ask_id) left join n using (ask_id)""",
}

QUERIES = {f.__name__: f for f in (embedded_passages, ask_hits, ask_sources, ask_outcomes)}
