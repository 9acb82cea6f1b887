"""Search plans for a table of asks, with built-in expressions; a helper only cuts a plan out of a model's answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import ascii_lower, docset_key, question_symbols, trimmed

#: What hints at a pack, in the order in which packs are found. A cue with capitals never fits the lowered text.
CUES = {
    "python": ("python", "asyncio", "django", "pytest", "pip ", "def ", "pypi", "cpython", "numpy", "pandas"),
    "cpp": ("c++", "cpp", "std::", "nullptr", "cmake", "template<", "cstdio", "cppreference", "clang"),
    "html": ("html", "<div", "<span", "aria-", "doctype", "semantic element"),
    "css": ("css", "flexbox", "grid-template", "stylesheet", "media query", "padding:", "margin:"),
    "javascript": ("javascript", "typescript", "ecmascript", "promise", "node.js", "nodejs", ".then(", "addEventListener"),
}
#: What makes a message technical, and all messages that are small talk.
TECHNICAL = ("`", "{", "}", ";", "(", ")", "=", "[", "]", "\n", "import ", "def ", "print", "#")
SMALL_TALK = (
    *("hi", "hi there", "hello", "hello there", "hello world", "hey", "hey there", "yo", "hola", "howdy", "sup", "greetings", "good morning", "good afternoon", "good evening", "good night"),
    *("how are you", "how are you doing", "how are you today", "hows it going", "how's it going", "how is it going", "whats up", "what's up", "what is up", "are you there", "are you real"),
    *("who are you", "what are you", "what can you do", "what do you do", "what can you help with", "what can you help me with", "can you help", "can you help me", "help"),
    *("thanks", "thank you", "thanks a lot", "thank you so much", "thx", "ty", "bye", "goodbye", "see you", "see ya", "ok", "okay", "nice", "cool", "great", "lol", "test", "testing"),
)
#: Bounds of a plan, the results that a question asks for, and those of a model's plan that names no number.
MOST_QUERY, MOST_QUERIES, MOST_SYMBOL, MOST_SYMBOLS, FEWEST, MOST, USUAL, UNNAMED = 240, 4, 100, 12, 4, 16, 8, 10


def inferred_docsets(message: Column) -> Column:
    low = ascii_lower(message)
    hints = [F.when(F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(low, c)), F.lit(pack)) for pack, cues in CUES.items()]
    return F.array_compact(F.array(*hints))


def sanitized(queries: Column, docsets: Column, symbols: Column, count: Column) -> dict[str, Column]:
    """The columns of a plan within their bounds; docsets are sorted by name, each once."""
    cut = F.transform(F.coalesce(queries, F.array().cast("array<string>")), lambda q: F.substring(trimmed(q), 1, MOST_QUERY))
    names = F.transform(F.coalesce(docsets, F.array().cast("array<string>")), docset_key)
    marks = F.transform(F.coalesce(symbols, F.array().cast("array<string>")), lambda s: F.substring(trimmed(s), 1, MOST_SYMBOL))
    return {
        "queries": F.slice(F.filter(cut, lambda q: q != ""), 1, MOST_QUERIES),
        "docsets": F.array_sort(F.array_distinct(names)),
        "symbols": F.slice(F.filter(marks, lambda s: s != ""), 1, MOST_SYMBOLS),
        "result_count": F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), count)).cast("int"),
    }


def plan(asks: DataFrame, available: list[str] | None = None) -> DataFrame:
    """ask_id and the plan of each ask (ask_id, message) for packs that are available, or for those of its own column docsets; docsets are sorted by name."""
    none = F.array().cast("array<string>")
    every = F.coalesce("docsets", none) if available is None else F.array(*map(F.lit, available)).cast("array<string>")
    message = F.coalesce("message", F.lit(""))
    first = F.substring(trimmed(message), 1, MOST_QUERY)
    symbols = question_symbols(message)
    symbol = F.get(symbols, F.lit(0))
    named = F.contains(ascii_lower(first), ascii_lower(symbol)) & (first != "")
    queries = F.array_compact(F.array(F.when(first != "", first), F.when(symbol.isNotNull() & ~named, symbol)))
    hints = inferred_docsets(message)
    scope = F.when(F.size(hints) == 0, every).when(F.size(every) == 0, hints).otherwise(F.array_intersect(hints, every))
    scope = F.when(F.array_contains(every, "local"), F.array_union(scope, F.array(F.lit("local")))).otherwise(scope)
    return asks.select("ask_id", *[c.alias(x) for x, c in sanitized(queries, scope, symbols, F.lit(USUAL)).items()])


def small_talk(message: Column) -> Column:
    """Whether a message needs no search."""
    text = trimmed(F.coalesce(message, F.lit("")))
    technical = F.exists(F.array(*map(F.lit, TECHNICAL)), lambda c: F.contains(text, c))
    plain = F.regexp_replace(F.lower(text), r"[!-&(-,./:-@\[-`{-~]", "")
    plain = trimmed(F.regexp_replace(plain, r"(?U)\s+", " "))
    return (text == "") | (~technical & plain.isin(*SMALL_TALK))


def first_object(answer: str | None) -> str | None:
    """The first balanced {...} after a model's thinking; braces in strings don't count."""
    text = (answer or "").rsplit("</think>", 1)[-1]
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for k in range(start, len(text)):
        c = text[k]
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : k + 1]
    return None


def parse_plans(answers: DataFrame) -> DataFrame:
    """ask_id, status and the plan of each answer (ask_id, message, answer) that a model wrote.

    status is plan, no object, or bad plan: text that is no JSON, no list of
    strings for queries, another type for an optional key, or a number of results
    that is no whole number from 0 on. Only a plan has columns that aren't null.
    An empty list of queries asks the message's start; a list of blanks asks nothing.
    """

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(first_object)

    part = lambda key: F.try_variant_get("v", f"$.{key}", "variant")  # noqa: E731  null without the key
    kind = lambda key: F.schema_of_variant(part(key))
    texts = lambda key: F.try_variant_get("v", f"$.{key}", "array<string>")
    all_text = lambda key: kind(key).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(texts(key), lambda x: x.isNull())
    optional = lambda key, fits: part(key).isNull() | F.coalesce(fits, F.lit(False))
    count = F.try_variant_get("v", "$.resultCount", "bigint")
    got = answers.withColumn("object", cut("answer")).withColumn("v", F.try_parse_json("object"))
    fits = F.coalesce(all_text("queries"), F.lit(False)) & optional("docsets", all_text("docsets")) & optional("symbols", all_text("symbols")) & optional("resultCount", (kind("resultCount") == "BIGINT") & (count >= 0))
    status = F.when(F.col("object").isNull(), "no object").when(F.col("v").isNotNull() & fits, "plan").otherwise("bad plan")
    queries = F.when(F.size(texts("queries")) > 0, texts("queries")).otherwise(F.array(F.substring(F.coalesce("message", F.lit("")), 1, MOST_QUERY)))
    columns = sanitized(queries, texts("docsets"), texts("symbols"), F.coalesce(count, F.lit(UNNAMED)))
    return got.withColumn("status", status).select("ask_id", "status", *[F.when(F.col("status") == "plan", c).alias(x) for x, c in columns.items()])
