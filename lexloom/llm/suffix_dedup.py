"""Removal of repeated byte strings by suffix sorting at content-defined anchors.

Every string of `length` bytes holds an anchor: the start of the gram with the
least hash of its grams. Equal grams meet in one shuffle of numbers; anchors whose
whole surroundings (the bytes that such strings can reach) equal earlier ones are
covered at once, those alone with their gram can't lie in a repeat. Only for the
first anchor of each of several different surroundings of one gram are bytes cut
out: their suffixes, and their reversed prefixes, are ordered by deep-shallow
sorting (multikey quicksort to a shallow depth, blind tries for the groups still
tied), and the common lengths of neighbours tell which strings occur earlier.
A gram of more than `many` different surroundings is first split in Spark as
multikey quicksort does: by where each parts from the earliest one (the pivot),
and by the byte there; no such group is held in one task.

Grams and surroundings are told apart by 64-bit hashes; bytes decide the rest.

Defined cases: a null text is empty; texts shorter than `length` lose
nothing; equal rows are one document and get equal results; different texts of
one id come in the order of their hashes; an empty table gives no rows; a null id
sorts first; further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed, small

WINDOW = 64
MANY = 10_000
#: Bytes hashed at once, and rows broadcast at most where they hold lists.
BUFFER, LISTS = 1 << 19, 300_000
LOWEST = -(2**63)
#: Strings judged at once, of contexts that share a gram.
CELLS = 100_000


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes over 0 of all k-byte grams, by doubling, then mixed."""
    n = len(b) - k + 1
    power, h = {1: np.uint32(0x01000193)}, {1: (b.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)}
    size = 1
    with np.errstate(over="ignore"):
        while size * 2 <= k:
            h[size * 2] = h[size][:-size] * power[size] + h[size][size:]
            power[size * 2] = power[size] * power[size]
            size *= 2
        out, at = np.zeros(n, np.uint32), 0
        while size:
            if k - at >= size:
                out = out * power[size] + h[size][at : at + n]
                at += size
            size //= 2
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x85EBCA6B)
        out ^= out >> np.uint32(13)
    return out | np.uint32(1)


def sliding(v: np.ndarray, w: int, best) -> np.ndarray:
    """best (minimum or maximum) over all runs of w, a power of two."""
    size = 1
    while size < w:
        v = best(v[:-size], v[size:])
        size *= 2
    return v


def row_hashes(m: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes, with more numbers mixed in."""
    wide = np.zeros((len(m), -(-m.shape[1] // 8) * 8), np.uint8)
    wide[:, : m.shape[1]] = m
    words, h = wide.view(np.uint64), np.full(len(m), 0x51ED270B, np.uint64)
    for x in [*(words[:, j] for j in range(words.shape[1])), *(y.astype(np.uint64) for y in more)]:
        h = (h ^ x) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def anchors(texts: list[bytes], length: int) -> pd.DataFrame:
    """Of each anchor: number of the text, pos, h (of its gram), c (of its surroundings), nl and nr (their bytes before it and from it)."""
    gram = length - WINDOW + 1
    b = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if len(b) < length:
        return pd.DataFrame({x: np.empty(0, np.int64) for x in ("text", "pos", "h", "c", "nl", "nr")})
    v = gram_hashes(b, gram)
    least = sliding(v, WINDOW, np.minimum)
    inside = np.zeros(len(least) + 1, np.int8)  # windows within one text
    fit = sizes >= length
    np.add.at(inside, starts[fit], 1)
    np.add.at(inside, ends[fit] - length + 1, -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, 0)
    pad = np.zeros(WINDOW - 1, np.uint32)
    at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), WINDOW, np.maximum) == v)
    text = np.searchsorted(ends, at, side="right")
    pos = at - starts[text]
    nl, nr = np.minimum(WINDOW - 1, pos), np.minimum(length, ends[text] - at)
    cells = np.arange(1 - WINDOW, length)
    held = b[np.clip(at[:, None] + cells, 0, len(b) - 1)]
    held[(cells < -nl[:, None]) | (cells >= nr[:, None])] = 0
    return pd.DataFrame({"text": text, "pos": pos, "h": row_hashes(held[:, WINDOW - 1 : WINDOW - 1 + gram]), "c": row_hashes(held, nl, nr), "nl": nl, "nr": nr})


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def blind_sorted(items: list[int], s: list[bytes]) -> list[int]:
    """Orders items by s through a blind trie: nodes keep only where strings part and the bytes there."""
    root = None  # a leaf is [equal items]; a node is (depth, {byte: child}); byte -1 is the end
    for i in items:
        x = s[i]
        if root is None:
            root = [i]
            continue
        node = root
        while isinstance(node, tuple):
            d, kids = node
            node = kids.get(x[d] if d < len(x) else -1) or next(iter(kids.values()))
        y = s[node[0]]
        if x == y:
            node.append(i)
            continue
        at, parent, key, node = common(x, y), None, None, root
        while isinstance(node, tuple) and node[0] < at:
            parent, key = node, x[node[0]] if node[0] < len(x) else -1
            node = node[1][key]
        mine = x[at] if at < len(x) else -1
        if isinstance(node, tuple) and node[0] == at:
            node[1][mine] = [i]
        else:
            fork = (at, {mine: [i], (y[at] if at < len(y) else -1): node})
            if parent is None:
                root = fork
            else:
                parent[1][key] = fork
    out, stack = [], [root] if root else []
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(s: list[bytes], shallow: int = 8) -> list[int]:
    """The order of the strings: multikey quicksort to the shallow depth, blind tries below it."""
    out: list[int] = []
    stack = [(list(range(len(s))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) <= 1:
            out += items
        elif depth >= shallow:
            out += blind_sorted(items, s)
        else:
            byte = lambda i: s[i][depth] if depth < len(s[i]) else -1  # noqa: E731, B023
            pivot = byte(items[len(items) // 2])
            less, same, more = [], [], []
            for i in items:
                c = byte(i)
                (less if c < pivot else more if c > pivot else same).append(i)
            stack.append((more, depth))
            stack.append((same, depth + 1 if pivot >= 0 else shallow))
            stack.append((less, depth))
    return out


def ordered(s: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each string, common lengths of neighbours in the order; 0 before the first)."""
    order = deep_shallow(s)
    rank = np.empty(len(s), np.int64)
    rank[order] = np.arange(len(s))
    return rank, np.array([0, *(common(s[a], s[b]) for a, b in zip(order, order[1:]))])


def covered(contexts: list[tuple[bytes, bytes]], length: int, few: int = 8) -> list[list[tuple[int, int]]]:
    """For contexts (bytes before the anchor, bytes after its gram) in order of first occurrence: the ranges, from the anchor, that strings seen in earlier contexts cover."""
    gram, m = length - WINDOW + 1, len(contexts)
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    (right, r_common), (left, l_common) = ordered([r for _, r in contexts]), ordered([x[::-1] for x, _ in contexts])
    if m <= few:
        reach = lambda rank, lcp, i, j: int(lcp[min(rank[i], rank[j]) + 1 : max(rank[i], rank[j]) + 1].min())
        for i in range(1, m):
            for j in range(i):
                a, b = reach(left, l_common, i, j), gram + reach(right, r_common, i, j)
                if a + b >= length:
                    out[i].append((-a, b))
        return out
    # all offsets of a block at once; a context's strings overlap, so their ranges are one
    nl, nr = np.array([len(x) for x, _ in contexts]), np.array([len(r) for _, r in contexts])
    most, least = np.full(m, -1), np.full(m, WINDOW)
    step = max(1, CELLS // m)
    for at in range(0, WINDOW, step):
        o = np.arange(at, min(at + step, WINDOW))[:, None]
        need = np.maximum(0, length - o - gram)
        key = (o * (m + 1) + (r_common < need).cumsum(1)[:, right]) * (m + 1) + (l_common < o).cumsum(1)[:, left]
        fit = np.flatnonzero(((nl >= o) & (nr >= need)).ravel())
        key = key.ravel()[fit]
        order = np.argsort(key, kind="stable")  # equal strings in the order of their contexts
        key = key[order]
        later = fit[order[1:][key[1:] == key[:-1]]]
        np.maximum.at(most, later % m, later // m + at)
        np.minimum.at(least, later % m, later // m + at)
    for i in np.flatnonzero(most >= 0).tolist():
        out[i].append((-int(most[i]), length - int(least[i])))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def utf8(t: str) -> bytes:
    return t.encode("utf-8", "surrogatepass")


def parted(work: DataFrame, length: int, many: int) -> tuple[DataFrame, list[DataFrame]]:
    """(contexts in groups g of at most `many`, spans found on the way): larger groups part from their earliest context, again and again."""
    gram, found = length - WINDOW + 1, []

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for g, i, tie, pos, x, r, px, pr in zip(*(pdf[c] for c in ("g", "id", "tie", "pos", "l", "r", "pl", "pr"))):
                a, b = common(x[::-1], px[::-1]), common(r, pr)
                if a + gram + b >= length:
                    rows.append((g, i, tie, pos, None, None, pos - a, pos + gram + b, 0, 0, 0))
                if b < len(r):
                    rows.append((g, i, tie, pos, x, r, 0, 0, 1, b, r[b]))
                if a < len(x):
                    rows.append((g, i, tie, pos, x, r, 0, 0, 2, a, x[-1 - a]))
            yield pd.DataFrame(rows, columns=["g", "id", "tie", "pos", "l", "r", "x", "y", "side", "at", "byte"])

    settled = None
    while True:
        big = checkpointed(work.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "tie", "pos")).alias("p")).filter(F.col("k") > many).select("g", "p"))
        if big.isEmpty():
            return work if settled is None else settled.union(work), found
        calm = work.join(small(big.select("g")), "g", "left_anti")
        settled = calm if settled is None else settled.union(calm)
        here = F.struct("id", "tie", "pos") == F.col("p")
        hot = work.join(small(big), "g")
        pivots = checkpointed(hot.filter(here).select("g", F.col("l").alias("pl"), F.col("r").alias("pr")).dropDuplicates(["g"]))
        moved = hot.filter(~here).drop("p").join(small(pivots), "g").mapInPandas(part, "g bigint, id bigint, tie int, pos bigint, l binary, r binary, x bigint, y bigint, side int, at int, byte int")
        moved = checkpointed(moved)
        found.append(moved.filter("side = 0").select("id", "tie", "x", "y"))
        split = moved.filter("side > 0").select(F.xxhash64("g", "side", "at", "byte").alias("g"), "id", "tie", "pos", "l", "r")
        alone = Window.partitionBy("g")
        work = checkpointed(split.withColumn("k", F.count(F.lit(1)).over(alone)).filter("k > 1").drop("k"))


def repeated_spans(docs: DataFrame, length: int, id_col: str, text_col: str, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): id, tie and text of every row; id, tie and merged byte ranges to remove, as far as there are any."""
    text, gram = F.coalesce(text_col, F.lit("")), length - WINDOW + 1
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("t"))
    marks = checkpointed(texts.select("id", "mark", F.octet_length("t").cast("long").alias("n")).distinct())
    # an id of several texts: tie tells them apart
    several = marks.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id")
    ties = checkpointed(marks.join(several, "id", "left_semi").select("id", "mark", (F.row_number().over(Window.partitionBy("id").orderBy("mark")) - 1).alias("tie")))
    tied = lambda df: df.join(small(ties), ["id", "mark"], "left").withColumn("tie", F.coalesce("tie", F.lit(0))) if some_ties else df.withColumn("tie", F.lit(0))
    some_ties = not ties.isEmpty()
    texts, marks = tied(texts).select("id", "tie", "t"), tied(marks)

    # copies of whole texts: the first one stands for all
    firsts = marks.groupBy("mark", "n").agg(F.min(F.struct("id", "tie")).alias("first"))
    later = marks.join(firsts, ["mark", "n"]).filter((F.struct("id", "tie") > F.col("first")) & (F.col("n") >= length))
    later = checkpointed(later.select("id", "tie", "n"))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(ids: list, held: list[bytes]) -> pd.DataFrame:
            out = anchors(held, length)
            own = np.array(ids, np.int64).reshape(-1, 2)[out["text"].to_numpy()]
            return out.assign(id=own[:, 0], tie=own[:, 1].astype(np.int32), ends=out["nl"] * 256 + out["nr"])[["h", "c", "id", "tie", "pos", "ends"]]

        for pdf in batches:
            ids, held, size = [], [], 0
            for i, tie, t in zip(pdf["id"].tolist(), pdf["tie"].tolist(), pdf["t"]):
                ids.append((i, tie))
                held.append(utf8(t))
                size += len(held[-1])
                if size >= BUFFER:
                    yield found(ids, held)
                    ids, held, size = [], [], 0
            if held:
                yield found(ids, held)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in the order of gram, surroundings and place: x and y of what repeats earlier surroundings, and as ask the first of surroundings whose gram has others."""
        last, held = None, None  # the last first row, and whether its gram had others before
        place = np.full((1, 3), LOWEST)  # the last row's; a repeated row says nothing

        for pdf in batches:
            if not len(pdf):
                continue
            h, c = pdf["h"].to_numpy(), pdf["c"].to_numpy()
            before_h = np.concatenate([[last["h"].iloc[0] if last is not None else h[0] ^ 1], h[:-1]])
            before_c = np.concatenate([[last["c"].iloc[0] if last is not None else c[0] ^ 1], c[:-1]])
            new = (h != before_h) | (c != before_c)
            places = np.concatenate([place, pdf[["id", "tie", "pos"]].to_numpy(np.int64)])
            place, repeated = places[-1:], (places[1:] == places[:-1]).all(axis=1)
            again = pdf[~new & ~repeated]
            x, y = again["pos"] - again["ends"] // 256, again["pos"] + again["ends"] % 256
            yield pd.DataFrame({"id": again["id"], "tie": again["tie"], "pos": again["pos"], "x": x, "y": y, "ask": False})
            rows = pdf[new] if last is None else pd.concat([last, pdf[new]])
            if len(rows) > (last is not None):
                hs = rows["h"].to_numpy()
                same = hs[1:] == hs[:-1]
                others = np.append(same, False) | np.concatenate([[bool(held)], same])
                asked = rows[:-1][others[:-1]]
                yield pd.DataFrame({"id": asked["id"], "tie": asked["tie"], "pos": asked["pos"], "x": 0, "y": 0, "ask": True})
                last, held = rows[-1:], others[-1]
        if last is not None and held:
            yield pd.DataFrame({"id": last["id"], "tie": last["tie"], "pos": last["pos"], "x": 0, "y": 0, "ask": True})

    kept = texts.filter(F.octet_length("t") >= length).join(small(later.select("id", "tie")), ["id", "tie"], "left_anti")
    found = kept.mapInPandas(mark, "h bigint, c bigint, id bigint, tie int, pos bigint, ends int")
    judged = found.repartition("h").sortWithinPartitions("h", "c", "id", "tie", "pos").mapInPandas(told, "id bigint, tie int, pos bigint, x bigint, y bigint, ask boolean")
    judged = checkpointed(judged)
    asked = judged.filter("ask").groupBy("id", "tie").agg(F.collect_set("pos").alias("at"))  # a text's own places

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, tie, t, at in zip(pdf["id"], pdf["tie"], pdf["t"], pdf["at"]):
                b = utf8(t)
                rows += [(b[p : p + gram], i, tie, p, b[max(0, p - WINDOW + 1) : p], b[p + gram : p + length]) for p in map(int, at)]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["gram", "id", "tie", "pos", "l", "r"])
                    rows = []
            yield pd.DataFrame(rows, columns=["gram", "id", "tie", "pos", "l", "r"])

    cuts = texts.join(small(asked, LISTS), ["id", "tie"]).mapInPandas(cut, "gram binary, id bigint, tie int, pos bigint, l binary, r binary")
    contexts = checkpointed(cuts.select(F.xxhash64("gram").alias("g"), "id", "tie", "pos", "l", "r"))
    contexts, spans = parted(contexts, length, many)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def judged(group: list) -> list:
            # a context may come from several rows of one document
            group = list({x[1:4]: x for x in group}.values())
            if len(group) < 2:
                return []
            return [(i, tie, pos + a, pos + b) for (_, i, tie, pos, *_), s in zip(group, covered([(x[4], x[5]) for x in group], length)) for a, b in merged(s)]

        for pdf in batches:
            rows = []
            for row in zip(*(pdf[c] for c in ("g", "id", "tie", "pos", "l", "r"))):
                if held and held[0][0] != row[0]:
                    rows += judged(held) if len(held) > 1 else []
                    held = []
                held.append(row)
            yield pd.DataFrame(rows, columns=["id", "tie", "x", "y"])
        if len(held) > 1:
            yield pd.DataFrame(judged(held), columns=["id", "tie", "x", "y"])

    compared = contexts.repartition("g").sortWithinPartitions("g", "id", "tie", "pos").mapInPandas(compare, "id bigint, tie int, x bigint, y bigint")
    spans = [*spans, compared, judged.filter("not ask").select("id", "tie", "x", "y"), later.select("id", "tie", F.lit(0).cast("long").alias("x"), F.col("n").alias("y"))]
    every = spans[0]
    for more in spans[1:]:
        every = every.union(more)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["id", "tie"]].assign(spans=[[v for ab in merged([(int(s["x"]), int(s["y"])) for s in found]) for v in ab] for found in pdf["found"]])

    by_text = every.groupBy("id", "tie").agg(F.collect_list(F.struct("x", "y")).alias("found"))  # a text's own spans
    return texts, checkpointed(by_text.mapInPandas(joined, "id bigint, tie int, spans array<bigint>"))


def dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    if not WINDOW + 8 <= length <= 255:
        raise ValueError(f"length is at least {WINDOW + 8} and at most 255")
    texts, spans = repeated_spans(docs, length, id_col, text_col, many)

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t, s in zip(pdf["id"], pdf["t"], pdf["spans"]):
                b, at, parts = utf8(t), 0, []
                gone = [] if s is None else list(zip(s[0::2].tolist(), s[1::2].tolist()))
                for x, y in gone:
                    parts.append(b[at:x])
                    at = y
                kept = b"".join([*parts, b[at:]])
                rows.append((i, len(b), len(b) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = texts.join(small(spans, LISTS), ["id", "tie"], "left").select("id", "t", "spans").mapInPandas(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LOWEST, F.col("doc_id")))
