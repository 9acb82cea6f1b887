"""Jaccard join of n-gram sets over prefix trees.

Each set is ordered globally: shingles of long words first (they are rare), those
that many sets hold last, by their counts. Two sets that link share a shingle of
their prefixes, and the first one they share leaves both enough of the rest to
reach the bound. A first pass sends each set, as its text, to one of the prefix
shingles that others have too; there a trie of the sets is walked with shared
partial overlaps; subtrees that can't reach the bound any more or are linked
already are left out. Large groups are dealt into blocks for this, and sets of a common
shingle that are still in several components are walked by it again. A second pass
makes it exact: sets of different components that share a prefix shingle, at
places where the remaining lengths still reach the bound, and whose parities (2,048
bits of a set) don't differ in more bits than linked sets can, are verified. So
copies of one text never meet pair by pair, and no link between components is lost.

Defined cases: null, empty and wordless texts have an empty set and link
with nothing; fewer than n words are one shingle; equal sets are one node, so
repeated rows share a component; a null id gets the component of its text;
an empty table gives no rows; further columns don't matter. Shingles are told
apart by 57-bit hashes and their words' lengths, sets and texts by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import ascii_lower, checkpointed, fresh, setting, small, space_words
from lexloom.llm.components import components


#: A shingle is one number: 5 bits that put long words first, and 57 bits of hash. Common ones come after all others.
HASH_BITS, COMMON = 57, 1 << 62
#: Numbers of 64 bits in a set's parity; a power of two.
PARITY = 32
#: A word is one number: its length, at most 31, and 58 bits of hash.
WORD_BITS = 58


def word_codes(text: Column) -> Column:
    lengths = lambda w: F.shiftleft(F.least(F.length(w), F.lit(31)).cast("long"), WORD_BITS)
    return F.transform(space_words(ascii_lower(text)), lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << WORD_BITS) - 1)).bitwiseOR(lengths(w)))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct runs of n words, ascending."""
    if not len(words):
        return np.empty(0, np.int64)
    h, n = words.view(np.uint64), min(n, len(words))
    size = len(h) - n + 1
    out, long = np.full(size, np.uint64(n)), np.zeros(size, np.uint64)
    for k in range(n):
        part = h[k : size + k]
        out = out * np.uint64(0x9E3779B97F4A7C15) + part
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        long += part >> np.uint64(WORD_BITS)
    rank = np.uint64(31) - np.minimum(long * np.uint64(3) // np.uint64(n), np.uint64(31))
    return np.unique((rank << np.uint64(HASH_BITS) | out >> np.uint64(64 - HASH_BITS)).view(np.int64))


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def required(x: int, y: int, percent: int) -> int:
    """The least intersection of sets of these sizes that link."""
    return -(-percent * (x + y) // (100 + percent))


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY numbers of 64 bits: whether each of their bits is hit by an odd number of shingles.

    Two sets' parities differ in no more bits than the sets differ in shingles.
    """
    at = (s.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (64 * PARITY - 1).bit_length())
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * PARITY).astype(np.uint8) & 1).view(np.int64)


def prefix_size(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def ordered(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """s with its common shingles (common is sorted) as COMMON plus their ranks, ascending."""
    if not len(common) or not len(s):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    often = common[at] == s
    return np.sort(np.where(often, COMMON + rank[at], s)) if often.any() else s


class Trie:
    """A trie of ordered sets as ranges of their sorted list, with the shingles of each edge.

    Shingles that no other set here has can't count in an overlap and are left
    out, like sets whose others can't reach the bound; the most frequent come first.
    Sets of one component (comps) are linked already.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, comps: list[int] | None = None):
        self.percent = percent
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int32)
        rank[np.lexsort((values, -counts))] = np.arange(len(values))
        inverse, at = inverse.astype(np.int32), np.cumsum([0, *map(len, sets)])
        del values
        kept = {}
        for i, s in enumerate(sets):
            own = inverse[at[i] : at[i + 1]]
            own = np.sort(rank[own[counts[own] > 1]])
            if len(own) >= required(len(s), -(-percent * len(s) // 100), percent):
                kept[i] = own
        del inverse, rank, counts
        self.order = sorted(kept, key=lambda i: kept[i].astype(">i4").tobytes())
        self.keys = [kept[i] for i in self.order]
        self.sizes = np.array([len(sets[i]) for i in self.order], np.int64)
        self.label = np.arange(len(self.order)) if comps is None else np.unique(np.array([comps[i] for i in self.order], np.int64), return_inverse=True)[1]
        self.root = self.build(0, len(self.order), 0) if self.order else None

    def build(self, lo: int, hi: int, depth: int):
        """(lo, hi, depth at the end, edge, least size, longest key, children); keys are sorted, so first and last tell what all share."""
        stack, made = [(lo, hi, depth, None)], []
        while stack:
            lo, hi, depth, parent = stack.pop()
            a, b = self.keys[lo], self.keys[hi - 1]
            m = min(len(a), len(b))
            differs = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(differs[0]) if len(differs) else m
            node = (lo, hi, end, a[depth:end], int(self.sizes[lo:hi].min()), max(len(k) for k in self.keys[lo:hi]), [])
            made.append(node)
            if parent is not None:
                parent[6].append(node)
            if hi - lo > 1:
                at = lo
                while at < hi and len(self.keys[at]) <= end:  # keys that end here
                    at += 1
                if at == hi:  # all of them are equal
                    continue
                if at > lo:
                    node[6].append((lo, at, end, a[:0], int(self.sizes[lo:at].min()), end, []))
                start = at
                for i in range(at + 1, hi + 1):
                    if i == hi or self.keys[i][end] != self.keys[start][end]:
                        stack.append((start, i, end, node))
                        start = i
        return made[0]

    def join(self) -> list[tuple[int, int]]:
        """Links (positions in sets) that connect all that link here, found one by one."""
        links: list[tuple[int, int]] = []
        for i in range(1, len(self.keys)):
            x, size = self.keys[i], int(self.sizes[i])
            stack = [(self.root, 0, 0)]
            while stack:
                (lo, hi, end, edge, least, longest, children), overlap, gone = stack.pop()
                hi = min(hi, i)
                if lo >= hi or overlap + min(longest - end + len(edge), len(x) - gone) < required(size, least, self.percent) or (self.label[lo:hi] == self.label[i]).all():
                    continue
                if len(edge):
                    at = np.searchsorted(x, edge)
                    overlap += int((x[np.minimum(at, len(x) - 1)] == edge).sum())
                    gone = int(np.searchsorted(x, edge[-1], side="right"))
                if overlap + min(longest - end, len(x) - gone) < required(size, least, self.percent):
                    continue
                if children:
                    stack += [(c, overlap, gone) for c in children]
                else:
                    for j in range(lo, hi):
                        if self.label[j] != self.label[i] and overlap >= required(size, int(self.sizes[j]), self.percent):
                            links.append((self.order[j], self.order[i]))
                            self.label[self.label == self.label[i]] = self.label[j]
        return links


def shingled(docs: DataFrame, n: int, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    """What make yields for a stream of (ids, marks of texts, shingle sets) of batches of documents."""
    hashed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), word_codes(F.col(text_col)).alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from make((pdf["id"].astype("Int64"), pdf["mark"], [shingles(np.asarray(h, dtype=np.int64), n) for h in pdf["h"]]) for pdf in batches)

    return hashed.mapInPandas(run, schema)


def having(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts (t) of asked (id, mark), with asked's columns."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("own"), F.col(text_col).alias("t"))
    return texts.join(small(asked), F.col("doc").eqNullSafe(F.col("id")) & (F.col("own") == F.col("mark"))).drop("doc", "own")


def repeated(sets: Iterator[np.ndarray], held: int) -> Iterator[pd.DataFrame]:
    """Numbers (token) that several sets hold, and how many (k), for about `held` numbers at a time.

    They lie in one array that is sorted where it is; nothing else grows with the numbers that are not repeated, but for a byte each.
    """
    numbers, size = np.empty(held, np.int64), 0

    def counted() -> pd.DataFrame:
        got = numbers[:size]
        got.sort()
        same = np.zeros(size + 1, bool)  # as the number before
        np.equal(got[1:], got[:-1], out=same[1:-1])
        first, last = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        return pd.DataFrame({"token": got[first], "k": last - first + 1})

    for s in sets:
        if size and size + len(s) > len(numbers):
            yield counted()
            size = 0
        if len(s) > len(numbers):
            numbers = np.empty(len(s), np.int64)
        numbers[size : size + len(s)] = s
        size += len(s)
    if size:
        yield counted()


def common_shingles(docs: DataFrame, n: int, id_col: str, text_col: str, least_common: int, max_common: int, held: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ranks by count) of those that over least_common sets hold, at most max_common, as far as single tasks see them repeated.

    They only order the sets: any choice gives the same links.
    """

    counts = shingled(docs, n, id_col, text_col, lambda stream: repeated((s for _, _, sets in stream for s in sets), held), "token bigint, k bigint").groupBy("token").agg(F.sum("k").alias("k")).filter(F.col("k") > least_common)
    often = counts.orderBy(F.desc("k"), "token").limit(max_common).toPandas()
    token, k = often["token"].to_numpy(np.int64), often["k"].to_numpy(np.int64)
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, k))] = np.arange(len(token))
    order = np.argsort(token)
    return token[order], rank[order]


def cluster(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", max_batch: int = 1_000, **options) -> DataFrame:
    """clustered, whose Python tasks get at most max_batch texts at a time: a batch lies in memory several times, in the JVM and in Python."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(docs.sparkSession.conf.get(rows))
    with setting(docs.sparkSession, rows, min(max_batch, own) if own > 0 else max_batch):
        return clustered(docs, n, percent, id_col, text_col, **options)  # all its Python runs here, the rest is lazy


def clustered(
    docs: DataFrame,
    n: int,
    percent: int,
    id_col: str,
    text_col: str,
    least_common: int = 50,
    max_common: int = 1_000_000,
    block: int = 500,
    block_shingles: int = 250_000,
    crowded: int = 50,
    rounds: int = 3,
) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id and mark (the 64-bit hash of its text).

    At most max_common shingles, held by over least_common sets, are ordered
    last by their counts; only they and tables of checked sizes are broadcast.
    Groups of over `block` sets, or of over block_shingles in all, are dealt into blocks, and shingles of over `crowded`
    sets are walked up to `rounds` times; none of these changes the result.
    """
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(docs, n, id_col, text_col, least_common, max_common))

    def prefixes(stream) -> Iterator[pd.DataFrame]:
        for ids, marks, sets in stream:
            sets = [ordered(s, *common.value) for s in sets]
            yield pd.DataFrame({"id": ids, "mark": marks, "node": [node_of(s) for s in sets], "size": [len(s) for s in sets], "prefix": [s[: prefix_size(len(s), percent)] if len(s) else s for s in sets], "parity": [parity(s) for s in sets]})

    every = checkpointed(shingled(docs, n, id_col, text_col, prefixes, "id bigint, mark bigint, node bigint, size bigint, prefix array<bigint>, parity array<bigint>"))
    nodes = every.filter("size > 0").groupBy("node").agg(F.min(F.struct("id", "mark", "size")).alias("first")).select("node", "first.*")

    # prefix shingles that other sets of a fitting size have too; rows of one shingle come in the order of sizes
    fits = lambda x, y: (100 * x >= percent * y) & (100 * y >= percent * x)
    rows = every.filter("size > 0").select("node", "size", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    rows = rows.groupBy("token", "node").agg(F.min("size").alias("size"), F.min("pos").alias("pos"))
    by_size = Window.partitionBy("token").orderBy("size", "node")
    near = rows.withColumn("below", F.lag("size").over(by_size)).withColumn("above", F.lead("size").over(by_size))
    near = near.filter(fits(F.col("below"), F.col("size")) | fits(F.col("above"), F.col("size"))).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("token"))).withColumn("mean", F.avg("size").over(Window.partitionBy("token")))
    rows = checkpointed(near.select("token", "node", "size", "pos", "k", "mean"))

    # each set that shares a shingle goes to the one that most sets share, up to a block, as text: shingles don't compress
    best = F.max(F.struct(F.col("k") <= block, F.when(F.col("k") <= block, F.col("k")).otherwise(-F.col("k")).alias("much"), (-F.col("token")).alias("token"), "k", "mean")).alias("key")
    keys = rows.groupBy("node").agg(best).select("node", (-F.col("key.token")).alias("token"), F.col("key.k").alias("k"), F.col("key.mean").alias("mean"), F.col("node").alias("comp")).join(nodes, "node")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [ordered(shingles(np.asarray(h, dtype=np.int64), n), *common.value) for h in pdf["h"]]
        got = {node_of(s): (s, c) for s, c in zip(sets, pdf["comp"], strict=True)}
        names = list(got)
        links = Trie([s for s, _ in got.values()], percent, [c for _, c in got.values()]).join() if len(names) > 1 else []
        return pd.DataFrame([(names[a], names[b]) for a, b in links], columns=["a", "b"], dtype="int64")

    def walked(keys: DataFrame, turn: int) -> DataFrame:
        # a task holds a block's sets: few long texts are as much as many short ones
        part = F.pmod(F.xxhash64("node", "token", F.lit(turn)), F.ceil(F.greatest(F.col("k") / block, F.col("k") * F.col("mean") / block_shingles)).cast("long"))
        asked = checkpointed(keys.select("id", "mark", "token", "comp", part.alias("part")))
        dealt = having(docs, asked, id_col, text_col).repartition("token", "part").select("token", "part", "comp", word_codes(F.col("t")).alias("h"))
        return dealt.groupBy("token", "part").applyInPandas(lambda p: walk(p), "a bigint, b bigint").distinct()

    links = checkpointed(walked(keys, 0))
    first = components(links)
    for turn in range(1, rounds):
        # crowds that still have several components meet anew, by the shingle that most of them share
        crowd = rows.filter(F.col("k") > crowded).drop("k", "mean").join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        apart = crowd.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.avg("size").alias("mean"), (F.min("comp") < F.max("comp")).alias("apart")).filter(F.col("apart") & (F.col("k") > crowded))
        most = crowd.join(apart, "token").groupBy("node").agg(F.max(F.struct("k", "token", "mean")).alias("key"), F.min("comp").alias("comp"))
        again = checkpointed(most.select("node", "key.*", "comp").join(nodes, "node"))
        if again.isEmpty():
            break
        links = checkpointed(links.union(walked(again, turn)))
        first = components(links)

    # what the blocks didn't show: shingles shared by sets of different components, where the rest still reaches the bound
    placed = rows.join(first, "node", "left").select("token", "node", "size", (F.col("size") - F.col("pos")).alias("rest"), F.coalesce("comp", "node").alias("comp"))
    placed = checkpointed(placed)
    comps = placed.groupBy("token", "comp").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.max("rest").alias("rest"), F.count(F.lit(1)).alias("n"))
    several = comps.groupBy("token").agg(F.count(F.lit(1)).alias("n_comps")).filter("n_comps > 1").select("token")
    comps = checkpointed(comps.join(several, "token"))
    needed = lambda x, y: F.ceil(percent * (x + y) / (100 + percent))
    x, y = comps.alias("x"), comps.alias("y")
    meet = (100 * F.col("x.hi") >= percent * F.col("y.lo")) & (100 * F.col("y.hi") >= percent * F.col("x.lo")) & (F.least("x.rest", "y.rest") >= needed(F.col("x.lo"), F.col("y.lo")))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.struct("x.n", "x.comp") < F.struct("y.n", "y.comp")) & meet)
    met = met.select(F.col("x.token").alias("t"), F.col("x.comp").alias("c"), F.col("y.comp").alias("cb"), F.col("y.lo").alias("lo"), F.col("y.hi").alias("hi"), F.col("y.rest").alias("most"))
    own = placed.select("token", F.col("comp").alias("ca"), F.col("node").alias("a"), F.col("size").alias("na"), F.col("rest").alias("ra"))
    # nodes of the smaller side that reach the bound with some size of the other one
    lowest = F.greatest("lo", F.ceil(percent * F.col("na") / 100))
    can = (lowest <= F.col("hi")) & (100 * F.col("na") >= percent * F.col("lo")) & (F.least("ra", "most") >= needed(F.col("na"), lowest))
    left = met.join(own, (F.col("t") == F.col("token")) & (F.col("c") == F.col("ca")) & can).select("token", "cb", "a", "na", "ra")
    right = placed.join(several, "token", "left_semi").select("token", F.col("comp").alias("cb"), F.col("node").alias("b"), F.col("size").alias("nb"), F.col("rest").alias("rb"))
    # sets that link differ in few shingles, so their parities do in few bits
    bits = lambda name: every.filter("size > 0").select(F.col("node").alias(name), *[F.col("parity")[k].alias(f"{name}{k}") for k in range(PARITY)]).dropDuplicates([name])
    left, right = left.join(bits("a"), "a"), right.join(bits("b"), "b")
    differ = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(PARITY)), F.lit(0))
    reach = fits(F.col("na"), F.col("nb")) & (F.least("ra", "rb") >= needed(F.col("na"), F.col("nb"))) & (differ <= F.col("na") + F.col("nb") - 2 * needed(F.col("na"), F.col("nb")))
    pairs = checkpointed(left.join(right, (left["token"] == right["token"]) & (left["cb"] == right["cb"]) & reach).select("a", "na", "b", "nb").distinct())

    # besides the prefix shingles that both have, the set whose prefix ends first can share what follows its prefix
    of_pairs = lambda: pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    named = small(of_pairs().join(nodes, "node").select(F.col("id").alias("i"), F.col("mark").alias("m"), "node"))
    lists = every.join(named, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")) & (every["node"] == named["node"])).select(every["node"], "prefix").dropDuplicates(["node"])
    lists = checkpointed(lists)
    after = lambda size: F.ceil(percent * F.col(size) / 100) - 1
    shared = F.size(F.array_intersect("pa", "pb")) + F.greatest(after("na"), after("nb"))
    met = pairs.join(lists.select(F.col("node").alias("a"), F.col("prefix").alias("pa")), "a").join(lists.select(F.col("node").alias("b"), F.col("prefix").alias("pb")), "b")
    pairs = checkpointed(met.filter(shared >= needed(F.col("na"), F.col("nb"))).select("a", "b"))

    @F.pandas_udf("boolean")
    def linked(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(u, v, assume_unique=True)) >= required(len(u), len(v), percent) for u, v in zip(p, q)], dtype=bool)

    ends = checkpointed(of_pairs().join(nodes, "node").select("id", "mark"))

    def whole(stream) -> Iterator[pd.DataFrame]:
        for _, _, sets in stream:
            sets = [ordered(s, *common.value) for s in sets]
            yield pd.DataFrame({"node": [node_of(s) for s in sets], "s": sets})

    sets = checkpointed(shingled(having(docs, ends, id_col, text_col), n, "id", "t", whole, "node bigint, s array<bigint>").dropDuplicates(["node"]))
    checked = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    more = checked.filter(linked("sa", "sb")).select("a", "b")
    labels = components(links.union(more))

    named = every.select("id", "mark", "node", "size").join(small(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = checkpointed(named.select("id", "mark", "size", "comp"))
    least = named.filter("size > 0").groupBy("comp").agg(F.min("id").alias("least"))
    out = named.filter("size > 0").join(least, "comp").select("id", "mark", "size", "least").union(named.filter("size = 0").select("id", "mark", "size", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("least").alias("component_id"), "mark")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with their own columns, less all texts but those of the smallest id of each component.

    Rows with a null id stay; rows of the kept id all stay, repeated ones too. A
    row goes by its id and text, so that another text of the same id is judged by itself.
    """
    i, m = fresh(docs, "gone_id", "gone_mark")
    gone = cluster(docs, n, percent, id_col, text_col, **options).filter("component_id <> doc_id").select(F.col("doc_id").alias(i), F.col("mark").alias(m)).distinct()
    return docs.join(small(checkpointed(gone)), (F.col(id_col).cast("long") == F.col(i)) & (F.xxhash64(F.col(text_col)) == F.col(m)), "left_anti")
