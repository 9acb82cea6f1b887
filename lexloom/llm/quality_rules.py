"""Quality rules with a verdict for each host, in DataFrame functions only.

Every text gets a few counts and rules; the failures of each rule are summed
by host, the host's failure rate is shrunk towards an empirical beta prior
(fitted by moments to the rates of all hosts), and the verdict on the host is
joined back to its documents.

Defined cases: a null text has no words; a null host has no verdict, so its
documents are judged by their own rules alone; repeated rows count once each;
an empty table gives no rows; further columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed, let, space_words

SYMBOLS = r"[#*$%&|<>]"
RULES = ("short", "repeats", "symbols", "lines")


def repeat_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in the array."""

    def windows(hashes: Column) -> Column:
        hashed = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - 3),
            lambda i: F.struct(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")),
        )
        return let(F.sort_array(hashed), covered)

    def covered(ordered: Column) -> Column:
        twins = F.filter(
            ordered,
            lambda x, k: x["h"].eqNullSafe(F.get(ordered, k - 1)["h"]) | x["h"].eqNullSafe(F.get(ordered, k + 1)["h"]),
        )
        starts = F.array_sort(F.transform(twins, lambda x: x["i"]))
        # a window adds the words that the one before it didn't cover
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= 4, let(hashes, windows)).otherwise(F.lit(0))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts that the rules read; the text is read once and not shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one_pass = let(
        space_words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeat_words(ws).cast("long").alias("n_repeat_words"),
        ),
    )
    by_line = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        one_pass.alias("w"),
        by_line.alias("l"),
        (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
    ).select("doc_id", "host", "w.*", "l.*", "n_symbols")


def rule_flags(min_words: int = 50, repeat_share: int = 50, symbol_share: int = 50, line_share: int = 50) -> dict[str, Column]:
    """Each rule as a boolean column; shares are per cent. The first two are the base rules."""
    n = F.col("n_words")
    return {
        "short": n < min_words,
        "repeats": 100 * F.col("n_repeat_words") > repeat_share * n,
        "symbols": 100 * F.col("n_symbols") > symbol_share * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > line_share * F.col("n_lines"),
    }


def host_verdicts(flagged: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, n_docs, the shrunk failure rate of each rule, and host_failed.

    The rates of all hosts give each rule's beta prior by moments: mean m and
    strength m (1 - m) / variance - 1, where the variance is that of the rates less the mean
    of m (1 - m) / documents, which counting alone would give them. A host's rate is then
    (failures + m * strength) / (documents + strength); where the hosts don't
    differ, the rate is m. A host fails if one of its rates exceeds max_rate.
    """
    named = flagged.filter(F.col("host").isNotNull())
    sums = checkpointed(
        named.groupBy("host").agg(
            F.count(F.lit(1)).alias("n_docs"),
            *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"n_{r}") for r in RULES],
        )
    )
    # one row of moments reaches the driver, however many hosts there are
    moments = sums.agg(
        *[F.avg(F.col(f"n_{r}") / F.col("n_docs")).alias(f"m_{r}") for r in RULES],
        *[F.var_pop(F.col(f"n_{r}") / F.col("n_docs")).alias(f"v_{r}") for r in RULES],
        F.avg(1 / F.col("n_docs")).alias("noise"),
    ).first()
    rates = {}
    for r in RULES:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        v -= m * (1 - m) * (moments["noise"] or 0.0)
        s = max(m * (1 - m) / v - 1, 0.0) if v > 1e-12 else None
        rates[r] = F.lit(m) if s is None else (F.col(f"n_{r}") + m * s) / (F.col("n_docs") + s)
    out = sums.select("host", "n_docs", *[rates[r].cast("double").alias(f"rate_{r}") for r in RULES])
    return out.withColumn("host_failed", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > max_rate)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = 0.5,
    **limits: int,
) -> DataFrame:
    """One row for each document: its counts, base_failed, host_failed and kept.

    The counts are written once to the checkpoint folder, since both the sums
    by host and the final rows read them. Hosts are joined by Spark's own
    choice of strategy: small tables are broadcast by their measured size,
    and a hot host's partition is split by AQE's skew join.
    """
    counts = text_counts(docs, id_col, text_col, host_col)
    flags = rule_flags(**limits)
    flagged = checkpointed(counts.select("*", *[c.alias(f"fails_{r}") for r, c in flags.items()]))
    hosts = host_verdicts(flagged, max_rate).select("host", "host_failed")
    joined = flagged.join(hosts, "host", "left")
    base = F.col("fails_short") | F.col("fails_repeats")
    return joined.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        *[f"fails_{r}" for r in RULES],
        base.alias("base_failed"),
        F.coalesce("host_failed", F.lit(False)).alias("host_failed"),
        (~base & ~F.coalesce("host_failed", F.lit(False))).alias("kept"),
    )
