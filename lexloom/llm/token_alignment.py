"""How the tokens of two tokenizers correspond in each text, and how common each pair of ids is.

Both tokenizers' ends are byte offsets of the same bytes. Where both end, a group ends.
Diagonal run skipping finds the groups: at the current shift between the two lists of
ends, stretches of one-to-one groups are jumped by probes of doubling length; an
irregular group is resolved token by token, which changes the shift.

A first pass writes each text's tokens' groups, digests and different id pairs. Spark
counts the texts of each pair. A second pass looks the commonest pairs up in a broadcast
table of at most HEAD pairs; all rarer ones are joined.

Defined cases: null and empty texts, and texts that one of the tokenizers doesn't give
back byte for byte, have no tokens. Repeated rows count as texts of their own. An
empty table gives an empty one. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed, dropped

#: Where the vocabularies are.
BYTE_MODEL, PIECE_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: The pattern that cuts text before the merges of the byte-level model, and the sign for a blank in pieces.
PATTERN, BLANK = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", "▁"
#: Pairs that are broadcast (16 bytes each), and bytes of texts that are aligned at once.
HEAD, AT_ONCE = 1_000_000, 1 << 20
#: Groups of a stretch that are looked at one by one, before probes; no tokens.
STEPS, NONE = 8, np.empty(0, np.int32)

FIRST = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
SECOND = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, best bigint, total bigint, rest array<bigint>, rest_times array<int>"


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 signs stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}


class Tokenizers:
    """Both tokenizers from the contents of their files, built once a process."""

    built: dict[bytes, Tokenizers] = {}

    def __init__(self, byte_model: bytes, piece_model: bytes):
        import sentencepiece
        import tiktoken

        signs = byte_signs()
        vocabulary = {bytes(signs[c] for c in word): n for word, n in json.loads(byte_model)["model"]["vocab"].items()}
        # ids are in the order of the merges
        self.a = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.size_a, self.size_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.bytes_a, self.bytes_b = [b""] * self.size_a, [self.piece(n) for n in range(self.size_b)]
        for word, n in vocabulary.items():
            self.bytes_a[n] = word
        self.length_a, self.length_b = (np.array([len(w) for w in words]) for words in (self.bytes_a, self.bytes_b))
        # ids in decimal, followed by what stands between two ids and after a group's last one
        self.text_a = np.array([f"{n}{end}" for end in ",|" for n in range(self.size_a)], dtype=object)
        self.text_b = np.array([f"{n}{end}" for end in ",;" for n in range(self.size_b)], dtype=object)

    def piece(self, n: int) -> bytes:
        text = self.b.id_to_piece(n)
        return bytes([int(text[3:5], 16)]) if self.b.is_byte(n) else text.replace(BLANK, " ").encode()

    @classmethod
    def of(cls, byte_model: bytes, piece_model: bytes) -> Tokenizers:
        key = hashlib.sha256(byte_model + piece_model).digest()
        if key not in cls.built:
            cls.built[key] = cls(byte_model, piece_model)
        return cls.built[key]

    def both(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text after a blank; none where the bytes aren't those of the text."""
        if text:
            a, b = self.a.encode_to_numpy(f" {text}"), self.b.encode(text)
            if b"".join(map(self.bytes_b.__getitem__, b)) == f" {text}".encode() == self.a.decode_bytes(a):
                return a, np.array(b, np.int32)
        return NONE, NONE


def runs(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(i, j, n): groups end with tokens i and j, i+1 and j+1 and so on, n in all; a and b rise to the same last end."""
    out, i, j, most = [], 0, 0, len(a)
    a, b = [*a, -1], [*b, -2]  # what ends every stretch
    while i < most:
        x, y = a[i], b[j]
        while x != y:  # an irregular group: its shorter side goes on
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        n = 1
        while n < STEPS and a[i + n] == b[j + n]:
            n += 1
        if n == STEPS:  # a long stretch: probes of doubling length, and then of halves within the last one
            step = STEPS
            while i + n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
                n += step
                step *= 2
            while step > 1:
                step //= 2
                if i + n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
                    n += step
        out.append((i, j, n))
        i += n
        j += n
    return out


def aligned(pair: Tokenizers, tokens: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """FIRST without the row and id, of texts given as their two lists of ids."""
    n_a, n_b = (np.array([len(t[k]) for t in tokens]) for k in (0, 1))
    a, b = (np.concatenate([t[k] for t in tokens]).astype(np.int64) for k in (0, 1))
    ends_a, ends_b = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])
    found = np.array(runs(ends_a.tolist(), ends_b.tolist()), np.int64).reshape(-1, 3)
    within = np.arange(found[:, 2].sum()) - np.repeat(np.cumsum(found[:, 2]) - found[:, 2], found[:, 2])
    last_a, last_b = (np.repeat(found[:, k], found[:, 2]) + within for k in (0, 1))

    # the groups' text: each side's ids in turn
    ends = np.zeros(len(a), int), np.zeros(len(b), int)
    for side, last in zip(ends, (last_a, last_b)):
        side[last] = 1
    group_a, group_b = np.cumsum(ends[0]) - ends[0], np.cumsum(ends[1]) - ends[1]
    text = np.empty(len(a) + len(b), dtype=object)
    text[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = pair.text_a[a + ends[0] * pair.size_a]
    text[np.arange(len(b)) + (last_a + 1)[group_b]] = pair.text_b[b + ends[1] * pair.size_b]
    stops = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
    text = text.tolist()
    digests = [hashlib.sha256("".join(text[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in pairwise(stops)]

    # links: from the first token that ends after one's start to the one that holds its last byte
    low = np.searchsorted(ends_b, ends_a - pair.length_a[a], "right")
    many = np.searchsorted(ends_b, ends_a, "left") - low + 1
    to = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - low, many)
    owner = np.repeat(np.arange(len(tokens)), n_a)
    keys, times = np.unique((np.repeat(owner, many) << 40) + np.repeat(a, many) * pair.size_b + b[to], return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(tokens) + 1) << 40)
    keys &= (1 << 40) - 1
    times = times.astype(np.int32)
    count = lambda of: np.bincount(of, minlength=len(tokens))
    parts = list(pairwise(cuts.tolist()))
    return pd.DataFrame({"n_a": n_a, "n_b": n_b, "n_groups": count(owner[last_a]), "n_links": count(np.repeat(owner, many)), "groups_sha256": digests, "pairs": [keys[s:e] for s, e in parts], "times": [times[s:e] for s, e in parts]})


def align(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    contents = []
    for name in (byte_model, piece_model):
        with open(name, "rb") as f:
            contents.append(f.read())
    # the files of two vocabularies
    models = spark.sparkContext.broadcast(contents)
    size_a, size_b = len(json.loads(contents[0])["model"]["vocab"]) + 1, Tokenizers.of(*contents).size_b

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = Tokenizers.of(*models.value)

        def made(rows: list[tuple], tokens: list) -> pd.DataFrame:
            return pd.concat([pd.DataFrame(rows, columns=["row", "doc_id"], dtype="object"), aligned(pair, tokens)], axis=1)

        for pdf in batches:
            rows, tokens, size = [], [], 0
            for row, doc, text in zip(pdf["row"], pdf["doc_id"], pdf["text"]):
                rows.append((row, None if pd.isna(doc) else int(doc)))
                tokens.append(pair.both(text))
                size += len(text or "")
                if size >= AT_ONCE or len(rows) >= 4_096:
                    yield made(rows, tokens)
                    rows, tokens, size = [], [], 0
            if rows:
                yield made(rows, tokens)

    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = checkpointed(named.mapInPandas(first, FIRST))
    counts = checkpointed(one.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))

    # counts that occur; then pairs as common as the broadcast has room for; then one number for each id of a
    usual = counts.groupBy("n").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("n")).toPandas()
    room = usual["pairs"].cumsum() <= head
    least = int(usual["n"][room].min()) if room.any() else None
    common = counts.filter(F.col("n") >= least).toPandas().sort_values("pair") if least is not None else pd.DataFrame({"pair": [], "n": []})
    highest = counts.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("n").alias("high"))
    found, high = highest.toPandas(), np.zeros(size_a, np.int64)
    high[found["a"].to_numpy(np.int64)] = found["high"]
    tables = spark.sparkContext.broadcast((common["pair"].to_numpy(np.int64), common["n"].to_numpy(np.int64), high))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n, high = tables.value
        for pdf in batches:
            if not len(pdf):
                continue
            sizes = pdf["pairs"].map(len).to_numpy()
            pairs, times = (np.concatenate(pdf[c].to_list()).astype(np.int64) for c in ("pairs", "times"))
            owner = np.repeat(np.arange(len(pdf)), sizes)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            held = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            value = np.where(held, n[at], 0) if len(known) else np.zeros(len(pairs), np.int64)
            top = held & (value == high[pairs // size_b])
            total, best = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            np.add.at(total, owner, value * times)
            np.add.at(best, owner, top * times)
            cuts = np.searchsorted(owner[~held], np.arange(len(pdf) + 1))
            rest, rest_times = pairs[~held], times[~held].astype(np.int32)
            parts = list(pairwise(cuts.tolist()))
            yield pdf.drop(columns=["pairs", "times"]).assign(best=best, total=total, rest=[rest[s:e] for s, e in parts], rest_times=[rest_times[s:e] for s, e in parts])

    two = checkpointed(one.mapInPandas(second, SECOND))
    rarer = two.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("r")).select("row", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times"))
    # one row at most for each id of a
    joined = rarer.join(counts, "pair").withColumn("a", F.floor(F.col("pair") / size_b)).join(F.broadcast(highest), "a")
    added = joined.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("n") == F.col("high"), F.col("times")).otherwise(0)).alias("more_best"))
    plus = lambda x, more: (F.col(x) + F.coalesce(F.col(more), F.lit(0))).cast("bigint")
    out = two.join(added, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("best", "more_best").alias("n_best"), plus("total", "more").alias("count_sum"), "groups_sha256")
    dropped(one)
    return out
