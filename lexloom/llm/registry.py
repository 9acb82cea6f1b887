"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontamination, hard_negatives, html_extraction, licenses, lm_scoring, ngram_join, pii, quality_classifier, quality_rules, secrets, sentencepiece, suffix_dedup, token_alignment
from lexloom.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("redacted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece.encode(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.array_join(F.coalesce("piece_ids", F.array().cast("array<int>")), ","), 256)
    return out.select("doc_id", "n_pieces", digest.alias("pieces_sha256"), F.coalesce(F.col("decoded") == F.col("text"), F.lit(True)).alias("round_trip"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(table(spark, sf_dir, "documents")).drop("mark")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.whole_vectors(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_pii, op3_sentencepiece, op4_quality_rules, op5_decontamination, op6_suffix_dedup, op7_html_extraction, op8_quality_classifier, op9_secrets, op10_ngram_join, op11_hard_negatives, op12_token_alignment, op13_licenses)}


#: DuckDB: the words of a text for decontamination.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB: the quality rules by name, as conditions on the counts of a text, and each host's rate shrunk by the prior of all hosts.
RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "symbols": "100 * n_symbols > 50 * word_chars", "lines": "100 * n_dup_lines > 50 * n_lines"}
each_rule = lambda form: ", ".join(form.format(r=r, rule=rule) for r, rule in RULES.items())

SQL = {
    "op4_quality_rules": f"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
p as (select r, i, ws[i : i + 2] as win from (select r, ws, unnest(range(1, len(ws) - 1)) as i from d)),
twice as (select r, i from p qualify count(*) over (partition by r, win) > 1),
w as (select r, count(distinct spot) as n_repeat_words from (select r, unnest(range(i, i + 3)) as spot from twice) group by all),
l as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by all),
c as (select doc_id, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words from d left join w using (r) left join l using (r)),
h as (select source, count(*) as n, {each_rule("count(*) filter ({rule}) as f_{r}")} from c where source is not null group by source),
a as (select {each_rule("avg(f_{r} / n) as m_{r}")}, {each_rule("var_pop(f_{r} / n) as raw_{r}")}, avg(1 / n) as noise from h),
v as (select *, {each_rule("raw_{r} - m_{r} * (1 - m_{r}) * noise as v_{r}")} from a),
s as (select *, {each_rule("greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 0) as s_{r}")} from v),
b as (select source, greatest({each_rule("case when v_{r} > 1e-12 then (f_{r} + m_{r} * s_{r}) / (n + s_{r}) else m_{r} end")}) > 0.5 as host_failed from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {RULES["short"]} or {RULES["repeats"]} as base_failed, not ({RULES["short"]} or {RULES["repeats"]}) and not coalesce(host_failed, false) as kept
from c left join b using (source)""",
    "op5_decontamination": f"""
with d as (select doc_id, {WORDS} as ws from documents), b as (select item_id, {WORDS} as ws, least(13, len(ws)) as k from benchmark where len(ws) > 0),
w as (select distinct item_id, k, ws[i : i + k - 1] as win from (select *, unnest(range(1, len(ws) - k + 2)) as i from b)),
p as (select doc_id, i, k, ws[i : i + k - 1] as win from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, (select distinct k from w))),
h as (select distinct doc_id, i, k, item_id from p join w using (k, win)),
c as (select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(i, i + k)) as spot from h) group by all),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by all)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join c using (doc_id) left join t using (doc_id)""",
    "op11_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as alike, list_inner_product(a.q, b.q)::bigint as score from v a join v b on b.vec_id <> a.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where alike qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select anchor_id, positive_id, positive_score, id as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank
  from p join s using (anchor_id) where not alike and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
