"""Secrets: character Markov models of random strings and of ordinary identifiers.

Both models are trained on bounded samples: what the base patterns find is
labelled random, other words and numbers of the texts ordinary, and so are names and
paths made of these words. A token whose log-likelihood
ratio per character exceeds the threshold is added to the base spans; the
threshold lets pass at most one of a thousand ordinary sample words that the
models didn't learn from. So keys without a telling name before them are found,
and UUIDs too, which look as random as keys do.

Defined cases: a null or empty text has no spans; repeated rows get a row
each; an empty table gives no rows; without random samples nothing is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.spans import Taken, digest, joined

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A token needs a letter, as bare numbers are no secrets, and 16 characters: shorter random strings are
#: told from words only by chance, and keys without a name before them are rarely shorter.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
ALPHABET = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.")}
SIZE = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def codes(token: str) -> np.ndarray:
    return np.array([0] + [ALPHABET.get(c, 0) for c in token])


def markov(samples: list[str]) -> np.ndarray:
    """Log probabilities of a character after another, with half a count added."""
    counts = np.full((SIZE, SIZE), 0.5)
    for s in samples:
        c = codes(s)
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def identifiers(words: list[str]) -> list[str]:
    """Names and paths made of a sample's words in turn, as texts without code have none to learn from."""
    plain = [w for w in words if w.isalpha()]
    out = []
    for k in range(len(plain) // 3):
        x, y, z = plain[3 * k : 3 * k + 3]
        n = k // 8
        ways = (f"{x}_{y}_{z}", f"{x.title()}{y.title()}{z.title()}", f"/{x}/{y}/{z}", f"{x}-{y}-{z}-{n % 100}", f"{x}_{y}_{n % 100}_{1990 + n % 60}", f"{x}{n % 20}/{y}_{z}", f"{x.upper()}_{y.upper()}_{z.upper()}", f"{x}{y.title()}{z.title()}{n % 10}")
        out.append(ways[k % 8])
    return out


#: The least log-likelihood ratio a character at which a token counts as random: samples can be too plain to tell.
LEAST = 0.25


class Model:
    def __init__(self, secrets: list[str], words: list[str], least: float = LEAST):
        own, held = words[0::2], words[1::2]
        self.table = markov(secrets) - markov(own + identifiers(own)) if secrets and own else None
        held = [w for w in held + identifiers(held) if len(w) >= 8] if self.table is not None else []
        self.threshold = max(least, float(np.quantile([self.ratio(w) for w in held], 0.999))) if held else least

    def ratio(self, token: str) -> float:
        c = codes(token)
        return float(self.table[c[:-1], c[1:]].mean())

    def added(self, text: str, base: list) -> list[tuple[str, int, int]]:
        if self.table is None:
            return []
        taken = Taken(base)
        return [("markov", m.start(), m.end()) for m in TOKEN.finditer(text) if not taken.overlaps(m.start(), m.end()) and self.ratio(m[0]) > self.threshold]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 2_000, max_chars: int = 20_000, max_words: int = 20_000, text_words: int = 200) -> Model:
    """Labelled samples from max_rows texts of at most max_chars (those with the smallest hashes of their ids): their base spans, and the first text_words words of each until there are max_words."""
    few = docs.filter((F.length(text_col) <= max_chars) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    ids = few.select("i").orderBy(F.xxhash64("i"), "i").limit(max_rows).distinct()
    secrets, words = [], []
    got = few.join(F.broadcast(ids), "i").groupBy("i").agg(F.min("t").alias("t")).collect()  # bounded by max_rows * max_chars
    for r in sorted(got, key=lambda r: r["i"]):
        spans = base_spans(r["t"])
        taken = Taken(spans)
        for kind, a, b in spans:
            secrets.append(ASSIGN.match(r["t"], a)[2] if kind == "assign" else r["t"][a:b])
        if len(words) < max_words:
            words += [m[0] for m in re.finditer(r"[A-Za-z0-9+/_=-]{4,}", r["t"]) if not taken.overlaps(m.start(), m.end())][:text_words]
    return Model([s for s in secrets if len(s) >= 6], words)


SCHEMA = "doc_id bigint, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Counts and spans of every document, in one pass without a shuffle."""
    model = train(docs, id_col, text_col, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["i"].tolist(), pdf["t"].tolist()):
                base = base_spans(t)
                spans = sorted(base + model.added(t, base), key=lambda s: s[1])
                rows.append((i, *[sum(k == kind for k, _, _ in base) for kind in KINDS], digest(base), joined(spans)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).mapInPandas(run, SCHEMA)
