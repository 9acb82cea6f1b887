"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are summed over all training texts, those seen
once included. A pair's count c is kept as 1 + floor(2 log2 c) entries (pair, level)
of a Bloom filter, so a count is read by probing level after level until one
is missing; it stands for the least count of its level. The filter lies in slices
by the n-grams' hashes, whose number follows the training tokens, so that one
slice is small at any size; it grows with the corpus and isn't broadcast whole.
Texts are dealt into blocks; a block asks each slice once for its different
n-grams there, and the answers meet the block again.

A pair's probability is its count smoothed with the word's own:
(c(vw) + mu * p(w)) / (c(v) + mu), where p(w) is the base probability. A count read
from the filter isn't above the true one (or c(v)), so that the probabilities after
a word sum to 1 at most. The base score needs exact counts of words, which come
back with the answers.

Defined cases: a null or empty text is one end token; a null id counts as
training; repeated rows get a row each; without training tokens all counts
are 0; further columns don't matter. Words are told apart by 64-bit hashes,
pairs by 40 bits within their slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import ascii_lower, checkpointed, space_words
from lexloom.llm.quality_classifier import in_fold

END = np.int64(-1)
SLICE_BITS = 1 << 23
BLOCK_TOKENS = 600_000
PROBES = 3
LEVELS = 80
#: Bits that tell a slice's pairs apart.
PAIR_BITS = 40


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def places(h: np.ndarray, level: int, probe: int) -> np.ndarray:
    """The bit of (n-gram, level) within its slice for this probe."""
    x = h.view(np.uint64) + np.uint64((0x94D049BB133111EB * level + 0xD6E8FEB86659FD93 * (probe + 1)) % 2**64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(SLICE_BITS)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Two levels for each doubling."""
    return 1 + np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.int64)


def estimate(level: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return np.where(level > 0, np.ceil(2.0 ** ((level - 1) / 2)), 0.0)


def slice_of(h: np.ndarray, n_slices: int) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(20)) % np.uint64(n_slices)).astype(np.int64)


def build_slice(h: np.ndarray, counts: np.ndarray) -> bytes:
    bits, top = np.zeros(SLICE_BITS, bool), levels(counts)
    for level in range(1, int(top.max(initial=0)) + 1):
        at = h[top >= level]
        for probe in range(PROBES):
            bits[places(at, level, probe)] = True
    return np.packbits(bits).tobytes()


class Filter:
    def __init__(self, slices: dict[int, bytes], n_slices: int):
        self.n = n_slices
        self.bits = np.zeros((n_slices, SLICE_BITS // 8), np.uint8)
        for k, v in slices.items():
            self.bits[k] = np.frombuffer(v, np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Each n-gram's highest level; 0 where level 1 is missing."""
        found, at, where = np.zeros(len(h), np.int64), np.arange(len(h)), slice_of(h, self.n)
        for level in range(1, LEVELS + 1):
            for probe in range(PROBES):
                p = places(h[at], level, probe)
                at = at[(self.bits[where[at], p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1]
            if not len(at):
                break
            found[at] = level
        return found


def packed(a: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest bytes each, compressed and led by that width."""
    a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
    return bytes([a.itemsize]) + zlib.compress(a.tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b[1:]), f"u{b[0]}").astype(np.int64)


def pairs_of(tokens: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of a block's different pairs, each token's pair, each token's word before); tokens are places in the sorted words, and every text ends with END."""
    before = np.append(np.searchsorted(words, END), tokens[:-1])
    pairs, inverse = np.unique(before.astype(np.int64) * len(words) + tokens, return_inverse=True)
    return pair_hash(words[pairs // len(words)], words[pairs % len(words)]), inverse, before


def by_slice(words: np.ndarray, pairs: np.ndarray, n_slices: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): a block's words and pairs by slice, words first, pairs by their bits there."""
    at = np.append(slice_of(words, n_slices), slice_of(pairs, n_slices))
    order = np.lexsort((np.append(np.full(len(words), -1), pairs & ((1 << PAIR_BITS) - 1)), at))
    return order, np.searchsorted(at[order], np.arange(n_slices + 1))


def short(pairs: np.ndarray) -> bytes:
    """Ascending numbers of PAIR_BITS bits: how many have each top byte, then their low 32 bits."""
    return np.bincount(pairs >> 32, minlength=1 << (PAIR_BITS - 32)).astype(np.uint32).tobytes() + pairs.astype(np.uint32).tobytes()


def long(b: bytes) -> np.ndarray:
    tops = np.frombuffer(b, np.uint32, 1 << (PAIR_BITS - 32)).astype(np.int64)
    return (np.repeat(np.arange(len(tops)), tops) << 32) + np.frombuffer(b, np.uint32, offset=4 * len(tops)).astype(np.int64)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = 8.0, block_tokens: int = BLOCK_TOKENS, slice_tokens: int = SLICE_BITS // 16) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    words_of = space_words(ascii_lower(F.col(text_col)))
    hashed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        (in_fold(F.col(id_col), 10, 0).cast("int") + F.when(F.col(id_col).cast("long").isNull(), 2).otherwise(0)).alias("flags"),
        F.transform(words_of, lambda w: F.xxhash64(w)).alias("h"),
    )

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def dealt_row() -> pd.DataFrame:
            tokens, lengths = np.concatenate([t for _, _, t in held]), np.array([len(t) for _, _, t in held], np.int32)
            flags = np.array([f for _, f, _ in held], np.uint8)
            words, tokens = np.unique(tokens, return_inverse=True)
            train = int(lengths[flags & 1 == 0].sum())
            row = (block, train, words.tobytes(), packed(tokens), np.array([i for i, _, _ in held], np.int64).tobytes(), flags.tobytes(), lengths.tobytes())
            return pd.DataFrame([row], columns=["block", "train", "words", "tokens", "ids", "flags", "lengths"])

        for pdf in batches:
            for i, f, h in zip(pdf["id"].tolist(), pdf["flags"].tolist(), pdf["h"]):
                held.append((i, f, np.append(np.asarray(h, dtype=np.int64), END)))
                size += len(h) + 1
                if size >= block_tokens:
                    yield dealt_row()
                    block, held, size = block + 1, [], 0
        if held:
            yield dealt_row()

    dealt = checkpointed(hashed.mapInPandas(deal, "block bigint, train bigint, words binary, tokens binary, ids binary, flags binary, lengths binary"))
    total = dealt.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    # a token is a word and a pair, so a slice has 8 bits for each occurrence at least
    n_slices = max(1, -(-total // slice_tokens))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's different words and pairs in each slice, with their counts in its training texts."""
        for pdf in batches:
            for block, words, tokens, flags, lengths in zip(pdf["block"], pdf["words"], pdf["tokens"], pdf["flags"], pdf["lengths"]):
                words, tokens = np.frombuffer(words, np.int64), unpacked(tokens)
                pairs, inverse, _ = pairs_of(tokens, words)
                train = np.repeat(np.frombuffer(flags, np.uint8) & 1 == 0, np.frombuffer(lengths, np.int32))
                k = np.append(np.bincount(tokens[train], minlength=len(words)), np.bincount(inverse[train], minlength=len(pairs)))
                order, starts = by_slice(words, pairs, n_slices)
                rows = []
                for s in np.flatnonzero(np.diff(starts)):
                    own = order[starts[s] : starts[s + 1]]
                    n = int((own < len(words)).sum())
                    rows.append((block, int(s), n, words[own[:n]].tobytes(), short(pairs[own[n:] - len(words)] & ((1 << PAIR_BITS) - 1)), packed(k[own])))
                yield pd.DataFrame(rows, columns=["block", "slice", "n", "words", "pairs", "k"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """The levels of all pairs and the exact counts of words asked for in a slice, and a row (block -1) with the number of its training words."""
        sides = {"words": [np.frombuffer(x, np.int64) for x in pdf["words"]], "pairs": [long(x) for x in pdf["pairs"]]}
        k = [unpacked(x) for x in pdf["k"]]
        n = pdf["n"].tolist()
        told = {}
        for side, lists in sides.items():
            own, inverse = np.unique(np.concatenate(lists), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([x[:m] if side == "words" else x[m:] for x, m in zip(k, n)]), minlength=len(own)).astype(np.int64)
            seen = counts > 0
            if side == "pairs":
                values = Filter({0: build_slice(own[seen], counts[seen])}, 1).levels(own)
            else:
                values, vocabulary = counts, int(seen.sum())
            ends = np.cumsum([len(x) for x in lists])[:-1]
            told[side] = np.split(values[inverse], ends)
        rows = [(-1, int(pdf["slice"].iloc[0]), None, None, vocabulary)]
        rows += [(b, s, packed(x), packed(y), 0) for b, s, x, y in zip(pdf["block"], pdf["slice"], told["pairs"], told["words"])]
        return pd.DataFrame(rows, columns=["block", "slice", "levels", "counts", "words"])

    asked = dealt.select("block", "words", "tokens", "flags", "lengths").mapInPandas(ask, "block bigint, slice bigint, n int, words binary, pairs binary, k binary")
    answers = checkpointed(asked.groupBy("slice").applyInPandas(answer, "block bigint, slice bigint, levels binary, counts binary, words bigint"))
    vocabulary = answers.filter("block = -1").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    whole = total + 0.1 * (vocabulary + 1)

    def score(blocks: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        own, got = blocks.iloc[0], got.sort_values("slice")
        words, tokens = np.frombuffer(own["words"], np.int64), unpacked(own["tokens"])
        flags, lengths = np.frombuffer(own["flags"], np.uint8), np.frombuffer(own["lengths"], np.int32)
        pairs, inverse, before = pairs_of(tokens, words)
        order, _ = by_slice(words, pairs, n_slices)
        level, counts = np.empty(len(pairs), np.int64), np.empty(len(words), np.int64)
        level[order[order >= len(words)] - len(words)] = np.concatenate([unpacked(x) for x in got["levels"]])
        counts[order[order < len(words)]] = np.concatenate([unpacked(x) for x in got["counts"]])
        base, context = ((counts + 0.1) / whole)[tokens], counts[before]
        smoothed = (np.minimum(estimate(level)[inverse], context) + mu * base) / (context + mu)
        starts = np.cumsum(lengths) - lengths
        summed = lambda v: np.add.reduceat(v, starts)
        return pd.DataFrame(
            {
                "doc_id": pd.array(np.frombuffer(own["ids"], np.int64), "Int64").copy(),
                "held_out": flags & 1 == 1,
                "n_tokens": lengths.astype(np.int64),
                "n_known": summed((counts > 0).astype(np.int64)[tokens]),
                "train_tokens": total,
                "base_score": summed(np.log10(base)),
                "score": summed(np.log10(smoothed)),
            }
        ).assign(doc_id=lambda d: d["doc_id"].mask(flags & 2 == 2))

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.drop("train").groupBy("block").cogroup(answers.filter("block >= 0").select("block", "slice", "levels", "counts").groupBy("block")).applyInPandas(score, schema)
