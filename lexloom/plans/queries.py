"""Registered queries over the given tables, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import docset_key, paragraphs, question_symbols, slug
from lexloom.operators import evidence
from lexloom.operators.lexical import bm25, postings, term_df
from lexloom.operators.lexical import corpus_stats as index_stats
from lexloom.operators.tables import chat_titles, idle_sessions, latest, recency
from lexloom.operators.vectors import cosine_topk, fuse
from lexloom.sources.tables import table


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25(chunks(spark, d), questions(spark, d))


def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    allowed = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))
    return bm25(chunks(spark, d), questions(spark, d), allowed=allowed)


def ranked_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each benchmark item asks with its text and with the vector of the same id."""
    v = table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")).distinct().join(v, "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    return bm25(chunks(spark, d), questions(spark, d), k=24), cosine_topk(v.select(F.col("vec_id").alias("chunk_id"), "embedding"), asked, k=24)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return fuse(*ranked_lists(spark, d))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return index_stats(chunks(spark, d))


def source_list(spark: SparkSession, d: str) -> DataFrame:
    return evidence.source_list(bm25_topk(spark, d))


def evidence_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return evidence.outcomes(questions(spark, d), bm25_topk(spark, d))


def plaintext_sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("section", "body")).select("doc_id", F.col("section").cast("long").alias("section"), F.md5("body").alias("body_md5"))


def recency_buckets(spark: SparkSession, d: str, now: str = "2024-01-31 00:00:00") -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts")).filter("ts is not null")
    return last.groupBy(recency(F.col("ts"), F.lit(now).cast("timestamp")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return term_df(postings(chunks(spark, d)))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return cosine_topk(v.select(F.col("vec_id").alias("chunk_id"), "embedding"), asked)


def document_symbols(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", question_symbols(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n_symbols"), F.array_join("s", " ").alias("symbols"))


def document_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", slug(F.col("text")).alias("slug"), docset_key(F.col("source")).alias("docset"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    return chat_titles(table(spark, d, "conversations"))


def latest_events(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return idle_sessions(table(spark, d, "events").filter("user_id is not null and ts is not null"), "user_id", "ts").select("user_id", F.col("session").cast("long").alias("session"), "started", "ended", "n_events")


#: DuckDB: the tokens of a text column.
TOKENS = r"flatten(list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_:.#-]+'), lambda t: list_concat([t], list_filter(regexp_split_to_array(t, '[:.#-]'), lambda p: strlen(p) > 1 and p <> t))))"

#: DuckDB: BM25 scores of all chunks that share a term with a question, and the best rows of such a table.
def bm25_sql(asked: str, docs: str = "documents") -> str:
    return f"""
with w as (select doc_id as chunk_id, {TOKENS.format("coalesce(text, '')")} as ts from ({docs if " " in docs else f"select * from {docs}"})),
s as (select count(*) as n, greatest(coalesce(avg(len(ts)), 0), 1) as a from w),
q as (select distinct query_id, unnest({TOKENS.format("question")}) as term from ({asked})),
c as (select term, chunk_id, len, count(*) as tf from (select chunk_id, len(ts) as len, unnest(ts) as term from w) where term in (select term from q) group by all),
f as (select term, count(*) as df from c group by all),
r as (select query_id, chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) as score from c join f using (term) join q using (term), s group by all)"""


BM25 = bm25_sql("select item_id as query_id, text as question from benchmark")
BEST = "select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from {0} where score > 0) where rank <= {1}"

#: DuckDB: the fused candidates of both lists, not cut yet.
FUSED = f"""{BM25}, l as ({BEST.format('r', 24)}),
p as (select q.vec_id as query_id, v.vec_id as chunk_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score from embeddings q, embeddings v where q.vec_id in (select item_id from benchmark)),
v as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from p) where rank <= 24),
b as (select *, 'l' as kind from l union all select query_id, chunk_id, score, rank, 'v' as kind from v),
g as (select query_id, chunk_id, sum(1.0::double / (60 + rank)) as score, max(score) filter (kind = 'l') as lexical_score, max(score) filter (kind = 'v') as semantic_score from b group by all)"""

#: DuckDB: names with a dot, :: or _, the first twelve different ones.
SYMBOLS = r"list_filter(regexp_extract_all({0}, '[A-Za-z0-9_:.#-]+'), lambda r: strlen(r) > 2 and regexp_matches(r, '\.|::|_'))"

SQL = {
    "document_symbols": f"""
with r as (select doc_id, {SYMBOLS.format('text')} as l from documents), d as (select doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:12] as s from r)
select doc_id, len(s)::bigint as n_symbols, array_to_string(s, ' ') as symbols from d""",
    "bm25_topk": f"{BM25}\n{BEST.format('r', 8)}",
    "bm25_filtered": f"{BM25}, e as (select * from r where chunk_id in (select doc_id from documents where lang = 'en'))\n{BEST.format('e', 8)}",
    "source_list": f"{BM25}\nselect query_id, 'S' || rank as source_id, chunk_id, score from ({BEST.format('r', 6)})",
    "evidence_outcomes": f"{BM25}, h as ({BEST.format('r', 8)}), n as (select query_id, count(*) as n from h group by all)\nselect query_id, coalesce(n, 0) as n_hits, case when n > 0 then 'evidence' else 'no evidence' end as status from (select distinct item_id as query_id from benchmark) left join n using (query_id)",
    "rrf_hybrid": f"""{FUSED}, x as (select * exclude (score), round(score, 6) as score from g)
select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from x) where rank <= 8""",
    "corpus_stats": f"select count(*) as n_docs, coalesce(sum(len({TOKENS.format("coalesce(text, '')")})), 0)::bigint as sum_terms from documents",
    "plaintext_sections": r"""
with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n'), lambda p: regexp_replace(regexp_replace(p, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*', chr(10), 'g')), lambda p: p <> '') as ps from documents)
select doc_id, unnest(range(len(ps))) as section, md5(unnest(ps)) as body_md5 from p""",
    "recency_buckets": """
with l as (select user_id, max(ts)::timestamp as ts from events group by all), a as (select epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(ts) as age from l where ts is not null)
select case when age < 86400000000 then 'today' when age < 604800000000 then 'week' else 'older' end as bucket, count(*) as n from a group by all""",
    "term_statistics": f"select term, count(*) as df from (select distinct doc_id, unnest({TOKENS.format('text')}) as term from documents) group by all",
    "vector_topk": """
with p as (select q.vec_id as query_id, v.vec_id as chunk_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score from embeddings q, embeddings v where q.vec_id % 100 = 0)
select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from p) where rank <= 48""",
    "titles": r"""
with f as (select conv_id, arg_min(text, turn) filter (role = 'user') as t from conversations group by all),
g as (select conv_id, trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g')) as t from f)
select conv_id, coalesce(nullif(case when length(t) > 48 then substr(t, 1, 47) || '…' else t end, ''), 'New chat') as title from g""",
    "latest_events": "select user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id",
    "sessions": """
with g as (select user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 900000000 then 0 else 1 end as s from events where user_id is not null and ts is not null),
n as (select *, sum(s) over (partition by user_id order by ts range between unbounded preceding and current row)::bigint as session from g)
select user_id, session, min(ts) as started, max(ts) as ended, count(*) as n_events from n group by user_id, session""",
    "document_slugs": r"select doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '-') as slug, case when source in ('python', 'cpp', 'html', 'css', 'javascript') then source else 'local' end as docset from documents",
}

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_filtered, rrf_hybrid, corpus_stats, source_list, evidence_outcomes, plaintext_sections, recency_buckets, term_statistics, vector_topk, document_symbols, document_slugs, titles, latest_events, sessions)}
