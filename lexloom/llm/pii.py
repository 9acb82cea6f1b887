"""Personal data: generators propose overlapping spans, boosted trees select.

Base patterns give spans that always stay. High-recall generators propose
further spans; trees boosted on format and context features score them, and
the smallest threshold of the wanted precision on held-out candidates selects.

The trees learn from a bounded sample what the base patterns can't tell: its base
spans are rewritten in place (signs spelled out, bracketed, blanked or left away,
digits grouped otherwise), FORMS times each, as right examples; candidates beside base
spans, and dates, times, versions, places and counts put in their places, are wrong ones. No feature
gives away whether a base pattern fits.

Defined cases: a null or empty text has no spans; repeated rows get a row
each; an empty table gives no rows; without a sample nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.boosting import Trees
from lexloom.llm.spans import Taken, digest, joined

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Signs of an address as people write them; bare words count for @ only beside a spelled-out dot.
OPEN, CLOSE = r"[(\[{<]", r"[)\]}>]"
AT = rf" ?(?:@|{OPEN} ?(?:at|@) ?{CLOSE}|_at_) ?"
WRITTEN_DOT = rf" ?{OPEN} ?(?:dot|\.) ?{CLOSE} ?|_dot_| dot "
DOT = rf" ?\. ?|{WRITTEN_DOT}"
#: What the generators propose: addresses and IPs with rewritten signs, and runs of digits and marks.
#: They reach as far as personal data do: 64 characters before the sign of an address
#: (the longest local part), 7 to 19 digits (the shortest phone number to the longest card
#: number) with marks between them, so 40 characters.
ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:(?:{WRITTEN_DOT})[A-Za-z0-9_%+-]{{1,64}}){{0,3}}(?:{AT}[A-Za-z0-9-]+(?:(?:{DOT})[A-Za-z0-9-]+)+| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)", re.I | re.A)
#: A text without any of these has no such address; the second needs them in lower case.
AT_SIGN, AT_WORDS = "@", re.compile(r"[(\[{<] ?at ?[)\]}>]|_at_| dot ")
QUAD = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{DOT})[0-9]{{1,3}}){{3}}(?![0-9])", re.I | re.A)
QUAD_SIGNS = re.compile(rf"[0-9](?: ?{OPEN} ?(?:dot|\.)|_dot_| dot )", re.I | re.A)
RUNS = (
    re.compile(r"(?<![0-9])[+(]?[0-9][0-9 ()._:/-]{5,38}[0-9](?![0-9])"),
    re.compile(r"(?<![0-9])[0-9]{7,19}(?![0-9])"),
)
SIGN = re.compile(r"@|[(\[{<_ ]at[)\]}>_ ]", re.I)
CUES = re.compile(r"mail|tel|phone|call|fax|card|contact|server|host|\bip\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping addresses; the local part is the run before each @."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            out.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = emails(text)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Proposed spans, which may overlap; texts without the signs of a form skip its search."""
    found = {(m.start(), m.end()) for p in RUNS for m in p.finditer(text)}
    if AT_SIGN in text or AT_WORDS.search(text.lower()):
        found |= {(m.start(), m.end()) for m in ADDRESS.finditer(text)}
    if QUAD_SIGNS.search(text):
        found |= {(m.start(), m.end()) for m in QUAD.finditer(text)}
    return sorted(found)


def features(text: str, a: int, b: int) -> list[float]:
    s, before = text[a:b], text[max(0, a - 24) : a]
    groups = re.findall("[0-9]+", s)
    digits, sizes = "".join(groups), [len(g) for g in groups] or [0]
    marks = [c for c in s if not c.isalnum()]
    return [
        float(b - a),
        float(len(digits)),
        float(len(groups)),
        float(max(sizes)),
        float(min(sizes)),
        float(sizes[0]),
        float(sizes[-1]),
        float(len(set(marks))),
        float(sum(c in "/:" for c in marks)),
        float(sum(c == "." for c in marks)),
        float(sum(c in " ()-" for c in marks)),
        float(any(c.isalpha() for c in s) and bool(SIGN.search(s))),
        float(len(digits) >= 13 and luhn(digits)),
        float(max((int(g[:6]) for g in groups), default=0)),
        float(bool(CUES.search(before))),
        float(before[-1:].isalnum() or text[b : b + 1].isalnum()),
    ]


N_FEATURES = 16
#: Right and wrong examples that each base span gives.
FORMS = 4


def rewritten(kind: str, s: str, pick: int) -> str:
    """A base span in a form that its pattern doesn't know."""
    if kind == "email":
        local, _, domain = s.partition("@")
        at, dot = ((" (at) ", "."), ("[at]", "[dot]"), (" @ ", "."), (" (at) ", " (dot) "), (" at ", " dot "), (" AT ", " DOT "), ("{at}", "."), ("<at>", "<dot>"), ("_at_", "_dot_"), ("[@]", "[.]"))[pick % 10]
        return local.replace(".", dot) + at + domain.replace(".", dot)
    digits = "".join(c for c in s if c in "0123456789")
    if kind == "ip":
        return s.replace(".", (" . ", ". ", ":", " .", "[.]", "(.)", " dot ", "[dot]", "_dot_")[pick % 9])
    if kind == "card":
        return (".", "/", "  ", " - ", "_", ":")[pick % 6].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    a, b, c, d = digits[:2], digits[2:5], digits[5:8], digits[8:]
    return (f"00{s[1:]}", f"({a}) {b} {c}{d}", s[1:], f"{a}.{b}.{c}{d}", f"00{a} {b} {c} {d}", f"+{a}/{b}/{c}{d}", f"{a} {b} {c} {d}", f"({a}{b}) {c}-{d}", f"{a}-{b}-{c}-{d}", f"+{a}_{b}_{c}{d}")[pick % 10].strip(" -")


def ordinary(seed: int) -> str:
    """A number, or words like those of an address, that are no personal data."""
    y, m, d, h, k = 1950 + seed % 100, 1 + seed % 12, 1 + seed % 28, seed % 24, seed % 60
    dates = (f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y} {h:02}:{k:02}", f"{y}-{y + m}", f"{d}/{m}/{y}", f"{y}{m:02}{d:02}{h:02}{k:02}", f"{d:02}/{m:02}/{y} - {d:02}/{1 + (m + 3) % 12:02}/{y}", f"{y}-{m:02}-{d:02} {h:02}:{k:02}:{d:02}", f"{h:02}:{k:02}:{d:02}")
    counts = (f"{d}.{h:03}.{k:03}", f"{m}.{d}.{h}.{k}{y}", f"0.{seed % 10**8:08}", f"{seed % 10**7}", f"{seed % 90}.{seed % 10**6:06} {seed % 180}.{seed // 3 % 10**6:06}", f"978-{m % 10}-{k:02}-{seed % 10**6:06}-{h % 10}", f"{seed % 10**6}/{seed // 5 % 10**6}", f"{d} {h} {k} {m} {y}")
    words = (f"arrived at noon dot {d}", f"{d} at {h} dot {k}")
    return (*dates, *counts, *words)[seed // 7 % 18]


def examples(text: str) -> Iterator[tuple[list[float], float]]:
    """Features of candidates and whether they are personal data."""
    base = base_spans(text)
    taken = Taken(base)
    for a, b in candidates(text):
        if not taken.overlaps(a, b):
            yield features(text, a, b), 0.0
    for n, (kind, a, b) in enumerate(base):
        seed = int.from_bytes(hashlib.blake2b(f"{n} {text[a:b]}".encode("utf-8", "replace"), digest_size=6).digest(), "little")
        forms = [(True, rewritten(kind, text[a:b], seed + k)) for k in range(FORMS)] + [(False, ordinary(seed // 4 + 7 * k)) for k in range(FORMS)]
        for good, new in forms:
            around = text[max(0, a - 60) : a] + new + text[b : b + 60]
            start = min(a, 60)
            end, near = start + len(new), [(x, y) for x, y in candidates(around) if x < start + len(new) and y > start]
            for x, y in near:
                yield features(around, x, y), float(good and x <= start + 1 and y >= end - 1 and y - x <= len(new) + 2)


class Selector:
    """Trees and the threshold that has the wanted precision on candidates kept from training."""

    def __init__(self, texts: list[str], precision: float = 0.98, max_candidates: int = 50_000):
        got = []
        for t in texts:
            got += examples(t)
            if len(got) >= max_candidates:
                break
        x, y = np.array([f for f, _ in got], dtype=float).reshape(-1, N_FEATURES), np.array([g for _, g in got])
        held = np.arange(len(y)) % 4 == 3
        self.model, self.threshold = None, np.inf
        if 0 < y[~held].sum() < (~held).sum():
            self.model = Trees(x[~held], y[~held])
            p = self.model.score(x[held])
            order = np.argsort(-p, kind="stable")
            right = np.cumsum(y[held][order]) / (np.arange(held.sum()) + 1)
            # only cut between different scores
            ends = np.append(np.diff(p[order]) != 0, True)
            good = np.flatnonzero((right >= precision) & ends)
            if len(good):
                self.threshold = float(p[order][good[-1]])

    def added(self, text: str, base: list) -> list[tuple[str, int, int]]:
        if self.model is None:
            return []
        taken = Taken(base)
        spans = [(a, b) for a, b in candidates(text) if not taken.overlaps(a, b)]
        if not spans:
            return []
        p, out = self.model.score(np.array([features(text, a, b) for a, b in spans])), []
        for k in np.lexsort(([a for a, _ in spans], -p)):
            if p[k] >= self.threshold and not taken.overlaps(*spans[k]):
                taken.add(*spans[k])
                out.append(("model", *spans[k]))
        return sorted(out, key=lambda s: s[1])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 2_000, max_chars: int = 20_000) -> Selector:
    """Learns from max_rows texts of at most max_chars with a digit or @: those with the smallest hashes of their ids."""
    few = docs.filter((F.length(text_col) <= max_chars) & F.col(text_col).rlike("[0-9@]") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    hit = few.select("i").orderBy(F.xxhash64("i"), "i").limit(max_rows).distinct()
    first = few.join(F.broadcast(hit), "i").groupBy("i").agg(F.min("t").alias("t"))
    return Selector([r["t"] for r in sorted(first.collect(), key=lambda r: r["i"])])


SCHEMA = "doc_id bigint, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Counts, spans and the redacted text of every document, in one pass without a shuffle."""
    model = train(docs, id_col, text_col, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["i"].tolist(), pdf["t"].tolist()):
                base, added = base_spans(t), []
                added = model.added(t, base)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((i, *counts, digest(base), joined(base + added), redact(t, base + added)))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).select(F.col("i"), "t").mapInPandas(run, SCHEMA)


def redact(text: str, spans: list, mark: str = "<PII>") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= end:
            out += [text[at:a], mark] if a >= at else []
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with their own columns, personal data replaced; null texts stay null."""
    model = train(docs, id_col, text_col, **options)

    @F.pandas_udf("string")
    def cleaned(s: pd.Series) -> pd.Series:
        return s.map(lambda t: redact(t, (base := base_spans(t)) + model.added(t, base)) if isinstance(t, str) else None)

    return docs.withColumn(text_col, cleaned(F.col(text_col)))
