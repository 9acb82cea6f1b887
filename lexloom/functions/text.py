"""Text expressions: tokens, symbols, slugs, titles, citations. All are built-in Spark functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The keys of the official packs; every other key means a local pack.
OFFICIAL = ("python", "cpp", "html", "css", "javascript")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and _ : . # -, then the parts of over one byte of those that have such a sign within."""
    low = F.lower(text)
    runs = F.array_remove(F.split(low, r"[^\p{IsAlphabetic}\p{N}_:.#-]+"), "")
    # runs with a sign in one pass over the text, as most runs have none
    signed = F.regexp_extract_all(low, F.lit(r"((?<![\p{IsAlphabetic}\p{N}_:.#-])[\p{IsAlphabetic}\p{N}_]*+[:.#-][\p{IsAlphabetic}\p{N}_:.#-]*+)"), F.lit(1))
    return F.concat(runs, F.filter(F.split(F.array_join(signed, " "), "[ :.#-]"), lambda p: F.octet_length(p) > 1))


def question_symbols(text: Column, most: int = 12) -> Column:
    """Names with a dot, :: or _ of over two bytes, in order of first sight."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_:.#-]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(runs, lambda r: (F.octet_length(r) > 2) & r.rlike(r"\.|::|_"))), 1, most)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+", "-"), F.lit("-"))


def docset_key(key: Column) -> Column:
    return F.when(key.isin(*OFFICIAL), key).otherwise(F.lit("local"))


def docset_named(name: Column) -> Column:
    """The key that a name, in any case, or another usual name of a pack means; null for all others."""
    low = ascii_lower(name)
    return F.when(low.isin(*OFFICIAL, "local"), low).when(low == "c++", "cpp").when(low == "js", "javascript")


def short_title(text: Column, most: int = 48) -> Column:
    """Blanks collapsed; over `most` characters, cut with an ellipsis; null when empty."""
    flat = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.nullif(F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat), F.lit(""))


def citations(text: Column) -> Column:
    """Ids like S1 of inline citations outside fenced blocks."""
    return F.regexp_extract_all(F.regexp_replace(text, "(?s)```.*?```", ""), F.lit(r"\[(S\d+)\]"), F.lit(1))


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, their lines trimmed; empty ones go."""
    cut = F.split(F.coalesce(text, F.lit("")), r"(?U)\n\s*\n")
    tidy = lambda p: F.regexp_replace(trimmed(p), r"(?U)\s*\n\s*", "\n")
    return F.filter(F.transform(cut, tidy), lambda p: p != "")


def path_title(path: Column) -> Column:
    """The file's name without its extension, with blanks for dashes and underscores."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?s)^(.+)\.[^.]*\z", "$1")
    return F.when(stem == "", "Documentation").otherwise(F.translate(stem, "-_", "  "))


#: Characters of a chunk, those that a part repeats of the one before, and headings in a chunk's label.
CHUNK, OVERLAP, LABEL = 5_200, 160, 6
#: Between headings of a label.
DOT = " \u00b7 "


def split_bounded(text: Column) -> Column:
    """Parts of at most CHUNK characters that end after a newline, dot, semicolon or brace of their second half, if there is one; each begins OVERLAP before the last one's end.

    A text within the bound is its own part as it is; an empty one has none. The
    fold reads two of the text's pages of CHUNK characters at a time, so that its
    time grows with the text's length.
    """
    kind = "struct<start:int,parts:array<string>>"
    start = lambda at, parts: F.struct(at.alias("start"), parts.alias("parts")).cast(kind)

    def split(t: Column) -> Column:
        def part(state: Column, window: Column) -> Column:
            at, last = state["start"], state["start"] + CHUNK >= t["n"]
            cut = F.length(F.regexp_extract(window, r"(?s)^(.*[\n.;}])", 1))
            end = F.when(last, t["n"] - at).when(cut > CHUNK // 2, cut).otherwise(CHUNK)
            return start(F.when(last, -1).otherwise(at + end - OVERLAP), F.concat(state["parts"], F.array(trimmed(F.substr(window, F.lit(1), end)))))

        def step(state: Column, _: Column) -> Column:
            page = F.floor(state["start"] / CHUNK).cast("int")
            both = F.concat(F.get(t["pages"], page), F.coalesce(F.get(t["pages"], page + 1), F.lit("")))
            window = F.substr(both, (state["start"] % CHUNK + 1).cast("int"), F.lit(CHUNK))
            return F.when(state["start"] < 0, state).otherwise(let(window, lambda w: part(state, w)))

        steps = F.sequence(F.lit(0), F.floor(t["n"] / (CHUNK // 2 - OVERLAP)).cast("int"))
        return F.aggregate(steps, start(F.lit(0), F.array().cast("array<string>")), step, lambda s: s["parts"])

    text = F.coalesce(text, F.lit(""))
    pages = F.struct(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{CHUNK}}})"), F.lit(1)).alias("pages"), F.length(text).alias("n"))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= CHUNK, F.array(text)).otherwise(let(pages, split))


def packed_chunks(sections: Column) -> Column:
    """array of (label, anchor, text): parts of sections, in order, packed into chunks of at most CHUNK characters.

    A chunk has the anchor of its first section and the label of its first LABEL
    headings; a heading stands before the first of its parts in a chunk.
    """
    one = "struct<label:string,anchor:string,text:string>"
    kind = f"struct<chunks:array<{one}>,held:string,heads:array<string>,anchor:string>"
    parts = F.flatten(F.transform(sections, lambda s: F.transform(split_bounded(F.concat(s["text"], F.array_join(F.transform(s["code"], lambda c: F.concat(F.lit("\n\nCODE:\n"), c)), ""))), lambda p: F.struct(s["heading"].alias("heading"), s["anchor"].alias("anchor"), p.alias("part")))))

    def state(chunks: Column, held: Column, heads: Column, anchor: Column) -> Column:
        return F.struct(chunks.alias("chunks"), held.alias("held"), heads.alias("heads"), anchor.alias("anchor")).cast(kind)

    def closed(s: Column) -> Column:
        made = F.struct(F.array_join(F.slice(s["heads"], 1, LABEL), DOT).alias("label"), s["anchor"].alias("anchor"), trimmed(s["held"]).alias("text"))
        return F.concat(s["chunks"], F.array(made.cast(one)))

    def step(s: Column, x: Column) -> Column:
        full = (s["held"] != "") & (F.length(s["held"]) + F.length(x["heading"]) + F.length(x["part"]) + 3 > CHUNK)
        none = F.array().cast("array<string>")
        room = F.when(full, state(closed(s), F.lit(""), none, s["anchor"])).otherwise(s)

        def added(r: Column) -> Column:
            known = F.coalesce(F.get(r["heads"], F.size(r["heads"]) - 1) == x["heading"], F.lit(False))
            head, heads = F.when(known, "").otherwise(F.concat(x["heading"], F.lit("\n"))), F.when(known, r["heads"]).otherwise(F.concat(r["heads"], F.array(x["heading"])))
            return state(r["chunks"], F.concat(r["held"], head, x["part"], F.lit("\n\n")), heads, F.when(r["held"] == "", x["anchor"]).otherwise(r["anchor"]))

        return let(room, added)

    begun = state(F.array().cast(f"array<{one}>"), F.lit(""), F.array().cast("array<string>"), F.lit("top"))
    return F.aggregate(parts, begun, step, lambda s: F.when(trimmed(s["held"]) != "", closed(s)).otherwise(s["chunks"]))
