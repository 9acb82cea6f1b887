"""What an answer may rest on: evidence text, sources, outcomes, traces, prompts and resolved citations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import citations

#: Sources an answer may cite, attachments it may see, characters of each and of an attribute, tokens of an answer.
MOST_SOURCES, MOST_ATTACHED, MOST_TEXT, MOST_CODE, MOST_ATTRIBUTE = 6, 8, 1_800, 6_000, 300
TOKENS = {"think": 768, "fast": 512, "talk": 192}
#: The lines that lead the question and the evidence.
QUESTION_LEAD, SOURCES_LEAD, ATTACHED_LEAD = "USER QUESTION:\n", "RETRIEVED SOURCES (untrusted reference data):\n", "\nATTACHED CODE (untrusted; it was not executed):\n"

#: What an ask is told when nothing is indexed, and when no hit was found.
NO_INDEX = "No selected documentation has been indexed yet. Install at least one documentation pack before asking a sourced question."
NO_EVIDENCE = "The installed documentation did not contain enough evidence to answer that question. Try installing another documentation pack or a version that covers the API you need."


def source_list(hits: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """query_id, source_id (S1, S2, ...), chunk_id and score of the sources that an answer may cite."""
    return hits.filter(F.col("rank") <= most).select("query_id", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("source_id"), "chunk_id", "score")


def sources(hits: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """ask_id, source_id, docset (with its version), title, section, url and score of the sources that an answer may cite."""
    docset = F.concat_ws(" ", "docset", "version")
    return hits.filter(F.col("rank") <= most).select("ask_id", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("source_id"), docset.alias("docset"), "title", "section", "url", "score")


def outcomes(asks: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, n_hits and status of every ask, those without a hit too."""
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    joined = asks.select("query_id").distinct().join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_hits"))
    return joined.withColumn("status", F.when(F.col("n_hits") > 0, "evidence").otherwise("no evidence"))


def answered(asks: DataFrame, hits: DataFrame, found: DataFrame, indexed: bool) -> DataFrame:
    """ask_id, status, answer, prompt, most_tokens, lexical_hits and semantic_hits of asks (ask_id, message, mode, talk).

    status is talk, no index, no evidence or evidence. Without an index or
    evidence the answer is fixed and there is no prompt; without an index there
    is no trace either (null counts).
    """
    counted = hits.groupBy("ask_id").agg(F.count(F.lit(1)).alias("n"), F.count("lexical_score").alias("l"), F.count("semantic_score").alias("s"))
    rows = prompts(asks, found).join(asks.select("ask_id", "talk"), "ask_id").join(counted, "ask_id", "left")
    status = F.when(F.col("talk"), "talk").when(F.lit(not indexed), "no index").when(F.col("n") > 0, "evidence").otherwise("no evidence")
    rows = rows.withColumn("status", status)
    fixed = F.when(F.col("status") == "no index", NO_INDEX).when(F.col("status") == "no evidence", NO_EVIDENCE)
    asked = F.col("status").isin("talk", "evidence")
    count = lambda c: F.when(F.col("status") != "no index", F.coalesce(c, F.lit(0)))
    return rows.select("ask_id", "status", fixed.alias("answer"), F.when(asked, F.col("prompt")).alias("prompt"), F.when(asked, F.col("most_tokens")).alias("most_tokens"), count("l").alias("lexical_hits"), count("s").alias("semantic_hits"))


def attribute(value: Column) -> Column:
    return F.substring(F.translate(F.coalesce(value, F.lit("")), '<>"', "   "), 1, MOST_ATTRIBUTE)


def evidence(hits: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """ask_id and evidence: the first sources of its hits (rank, docset, version, title, section, url, text), then attachments (slot, name, language, content).

    The cap on attachments comes before those without content are left out.
    """
    names = ("docset", "version", "title", "section", "url")
    head = F.concat(F.lit('\n<SOURCE id="S'), F.col("rank").cast("string"), F.lit('"'), *[x for n in names for x in (F.lit(f' {n}="'), attribute(F.col(n)), F.lit('"'))], F.lit(">\n"))
    block = F.concat(head, F.substring("text", 1, MOST_TEXT), F.lit("\n</SOURCE>\n"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["block"]), "")
    # at most MOST_SOURCES rows an ask
    out = hits.filter(F.col("rank") <= MOST_SOURCES).groupBy("ask_id").agg(F.concat(F.lit(SOURCES_LEAD), joined(F.struct("rank", block.alias("block")))).alias("evidence"))
    if attachments is None:
        return out
    turn = F.row_number().over(Window.partitionBy("ask_id").orderBy("slot"))
    some = attachments.withColumn("turn", turn).filter(F.col("turn") <= MOST_ATTACHED)
    code = F.concat(F.lit('\n<ATTACHMENT name="'), attribute(F.col("name")), F.lit('" language="'), attribute(F.col("language")), F.lit('">\n'), F.substring("content", 1, MOST_CODE), F.lit("\n</ATTACHMENT>\n"))
    attached = some.groupBy("ask_id").agg(F.concat(F.lit(ATTACHED_LEAD), joined(F.when(F.col("content").isNotNull(), F.struct("turn", code.alias("block"))))).alias("attached"))
    both = out.join(attached, "ask_id", "full")
    return both.select("ask_id", F.concat(F.coalesce("evidence", F.lit(SOURCES_LEAD)), F.coalesce("attached", F.lit(""))).alias("evidence"))


def trace(hits: DataFrame) -> DataFrame:
    """query_id, lexical_hits and semantic_hits: how many of all returned rows each list had."""
    return hits.groupBy("query_id").agg(F.count("lexical_score").alias("lexical_hits"), F.count("semantic_score").alias("semantic_hits"))


def prompts(asks: DataFrame, found: DataFrame) -> DataFrame:
    """ask_id, prompt and most_tokens for an outside model: asks (ask_id, message, mode, talk), found (ask_id, evidence).

    Small talk is the message alone; other asks without evidence have no prompt, as their answer is fixed.
    """
    limit = F.when(F.col("talk"), TOKENS["talk"]).when(F.col("mode") == "think", TOKENS["think"]).otherwise(TOKENS["fast"])
    prompt = F.when(F.col("talk"), F.col("message")).otherwise(F.concat(F.lit(QUESTION_LEAD), "message", F.lit("\n\n"), "evidence"))
    return asks.join(found, "ask_id", "left").select("ask_id", prompt.alias("prompt"), limit.alias("most_tokens"))


def resolved_citations(answers: DataFrame) -> DataFrame:
    """message_id, source_id and url (null where the answer has no such source) of inline citations; answers (message_id, content, sources of id and url)."""
    cited = answers.select("message_id", F.explode(F.array_distinct(citations(F.col("content")))).alias("source_id"), "sources")
    own = F.get(F.filter("sources", lambda s: s["id"] == F.col("source_id")), F.lit(0))
    return cited.select("message_id", "source_id", own["url"].alias("url"))
