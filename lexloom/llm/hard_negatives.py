"""Hard negatives of anchors, found exactly through an inverted multi-index.

The halves of the vectors have a codebook each; a cell is a pair of codes. An anchor's
inner product with a row of a cell is at most the sum of both halves' bounds: product
with the code plus the anchor's length times the code's radius. A heap over the two
sorted lists of bounds visits cells from the highest sum down, and ends where the bound
is below what each window of the anchor still needs. Cells are dealt into blocks of at
most some BLOCK rows, visits and blocks are joined in Spark, and each pair is a matrix
product in a task. Where bounds exclude nothing, as for vectors without clusters, all
cells are visited, and rows are still exact.

Defined cases: rows with a null id, label or vector, with a null or non-finite
component, or of another length than the commonest (the smaller on ties) take no part;
neither do empty vectors. Of rows with one id, the one with the smallest label, then
vector, counts. Ties go to the smaller id. Without rows or anchors the result is empty.
Components whose products could pass 2^53 are an error, as scores would not be whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.common import checkpointed, dropped

#: Rows of the sample that codebooks are fitted on, codes of a half, rows of a block, anchors of a matrix product.
SAMPLE, CODES, BLOCK, ANCHORS = 8_192, 32, 1_024, 512
#: Rows that an anchor's first round visits; the second visits all that the bounds then allow.
FIRST = 4_096
#: Results that a task holds before it reduces them to the best.
HELD = 200_000

RESULT = "anchor_id bigint, part int, score bigint, id bigint"
VISITS = "block int, anchors array<bigint>, labels array<bigint>, vectors binary, lows array<double>, highs array<double>"


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and vector: floor(scale * x) of each component; rows that take no part are gone."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~odd)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("vector"))


def codebook(points: np.ndarray, codes: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's centres, begun at different points in their order."""
    _, first = np.unique(points, axis=0, return_index=True)
    centres = points[np.sort(first)[:codes]].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        for k in np.unique(near):
            centres[k] = points[near == k].mean(0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - (centres**2).sum(1) / 2, axis=1)


def visited(upper: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[float, int, int]]:
    """(bound, first code, second code) of all cells, the highest sums of both lists first; a heap of one cell a first code."""
    one, two = (np.argsort(-u, kind="stable") for u in upper)
    a, b = upper[0][one].tolist(), upper[1][two].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(one[i]), int(two[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


class Index:
    """Codebooks, radii, and the blocks of each cell: of a size that parameters bound."""

    def __init__(self, books, radii, counts: np.ndarray, size: int):
        self.books, self.radii, self.counts = books, radii, counts
        self.first, self.parts, at, room = np.zeros(len(counts), int), np.ones(len(counts), int), 0, size
        for cell, n in enumerate(counts.tolist()):
            if n > room and room < size:  # the block is full
                at, room = at + 1, size
            self.first[cell] = at
            if n > size:  # a large cell has blocks of its own
                self.parts[cell] = -(-n // size)
                at, room = at + self.parts[cell], size
            else:
                room -= n

    def bounds(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(upper, lower) of each anchor and code, for both halves; a little wide, for rounding."""
        out, at = [], 0
        for book, radius in zip(self.books, self.radii):
            half = vectors[:, at : at + book.shape[1]]
            at += book.shape[1]
            middle, wide = half @ book.T, np.linalg.norm(half, axis=1)[:, None] * radius
            slack = 1e-9 * (np.abs(middle) + wide) + 1e-3
            out.append((middle + wide + slack, middle - wide - slack))
        return out

    def blocks(self, bounds, k: int, need: float, top: float, skip: int, quota: int | None) -> list[int]:
        """Blocks that anchor k visits after the first `skip` rows, up to quota rows, while a bound reaches need; cells all above top aren't asked."""
        (up1, low1), (up2, low2) = ((u[k], w[k]) for u, w in bounds)
        seen, found, rows = set(), {}, 0
        for bound, i, j in visited((up1, up2)):
            if quota is not None and rows >= quota or rows >= skip and bound < need:
                break
            cell = i * len(up2) + j
            if n := int(self.counts[cell]):
                if low1[i] + low2[j] <= top:
                    own = range(self.first[cell], self.first[cell] + self.parts[cell])
                    if rows < skip:
                        seen.update(own)
                    else:
                        found.update(dict.fromkeys(own))
                rows += n
        return [b for b in found if b not in seen]


def best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of each anchor and part."""
    return rows.sort_values(["anchor_id", "part", "score", "id"], ascending=[True, True, False, True]).groupby(["anchor_id", "part"], sort=False).head(k)


def matched(ids, anchors, scores, allowed, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor number, row number) of at least the k best allowed rows of each anchor, with all that tie with the last."""
    masked = np.where(allowed, scores, -np.inf)
    if masked.shape[1] > k:
        last = np.partition(masked, -k, axis=1)[:, -k][:, None]
        allowed = allowed & (masked >= last)
    return np.nonzero(allowed)


def search(index: Index, held: DataFrame, state: DataFrame, kind: str, same: bool, k: int, skip: int, quota: int | None) -> DataFrame:
    """RESULT rows of one round: state has vec_id, label, vector, need, lows and highs (of each part's window)."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ANCHORS):
                pdf = batch.iloc[at : at + ANCHORS]
                vectors = np.stack(pdf["vector"].to_list()).astype(float)
                bounds, asked = index.bounds(vectors), {}
                lows, highs = np.stack(pdf["lows"].to_list()), np.stack(pdf["highs"].to_list())
                ids, labels, small = pdf["vec_id"].to_numpy(), pdf["label"].to_numpy(), vectors.astype(kind)
                for n, need in enumerate(pdf["need"]):
                    for b in index.blocks(bounds, n, need, highs[n].max(), skip, quota):
                        asked.setdefault(b, []).append(n)
                rows = [(b, ids[own], labels[own], small[own].tobytes(), lows[own].ravel(), highs[own].ravel()) for b, own in sorted(asked.items())]
                for k in range(0, len(rows), 64):
                    yield pd.DataFrame(rows[k : k + 64], columns=[c.split()[0] for c in VISITS.split(", ")])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n_found = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                anchors, labels, ids, own = (np.asarray(x) for x in (r.anchors, r.labels, r.ids, r.own))
                scores = np.frombuffer(r.vectors, kind).astype(float).reshape(len(anchors), -1) @ np.frombuffer(r.rows, kind).astype(float).reshape(len(ids), -1).T
                alike = labels[:, None] == own
                fit = alike & (anchors[:, None] != ids) if same else ~alike
                lows, highs = (np.asarray(x).reshape(len(anchors), -1) for x in (r.lows, r.highs))
                for part in range(lows.shape[1]):
                    a, b = matched(ids, anchors, scores, fit & (scores >= lows[:, part, None]) & (scores <= highs[:, part, None]), k)
                    if len(a):
                        found.append(pd.DataFrame({"anchor_id": anchors[a], "part": np.full(len(a), part, np.int32), "score": scores[a, b].astype(np.int64), "id": ids[b]}))
                        n_found += len(a)
                if n_found > HELD:
                    found = [best(pd.concat(found), k)]
                    n_found = len(found[0])
                    if n_found > HELD // 2:
                        yield found.pop()
                        n_found = 0
        if found:
            yield best(pd.concat(found), k)

    visits = state.mapInPandas(visit, VISITS)
    return visits.join(held, "block").drop("block").mapInPandas(score, RESULT)


def leading(rows: DataFrame, k: int) -> DataFrame:
    """rows with their rank, up to k, within anchor_id and part."""
    order = Window.partitionBy("anchor_id", "part").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def searched(index: Index, held: DataFrame, state: DataFrame, kind: str, same: bool, k: int, first: int) -> DataFrame:
    """The k best of each window in two rounds: the second visits what the first one's rows leave possible."""
    one = checkpointed(leading(search(index, held, state.withColumn("need", F.lit(float("-inf"))), kind, same, k, 0, first), k).drop("rank"))
    # k rows at most of each window
    full = one.groupBy("anchor_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
    asked = state.select("vec_id", F.posexplode(F.arrays_zip("lows", "highs")).alias("part", "w")).filter("w.lows <= w.highs")
    needs = asked.join(full, (F.col("vec_id") == F.col("anchor_id")) & (asked["part"] == full["part"]), "left").groupBy("vec_id").agg(F.min(F.when(F.col("n") >= k, F.col("last").cast("double")).otherwise(F.col("w.lows"))).alias("need"))
    two = search(index, held, state.join(needs, "vec_id"), kind, same, k, first, None)
    out = checkpointed(leading(one.unionByName(two), k))
    dropped(one)
    return out


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, codes: int = CODES, block: int = BLOCK, first: int = FIRST, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows (vec_id, label, vector of whole numbers).

    An anchor's positives are its best rows of the same label; a positive's
    negatives are the best rows of other labels whose score is low to high per
    cent of the positive's.
    """
    spark = vectors.sparkSession
    one = vectors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")
    rows = checkpointed(one)
    kinds = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.array_max("vector"), -F.array_min("vector"))).alias("most"))
    commonest = kinds.orderBy(F.desc("n"), "dim").first()
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if commonest is None:
        return spark.createDataFrame([], result)
    dim, most = commonest["dim"], commonest["most"]
    if most * most * dim >= 2**53:
        raise ValueError(f"components of up to {most} give scores that doubles can't hold")
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
    rows = rows.filter(F.size("vector") == dim)

    # the sample's bound is a parameter
    some = np.stack(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()["vector"].to_list()).astype(float)
    books = [codebook(half, codes) for half in (some[:, : dim // 2], some[:, dim // 2 :])]
    second = len(books[1])

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.stack(pdf["vector"].to_list()).astype(float) if len(pdf) else np.zeros((0, dim))
            halves = (v[:, : dim // 2], v[:, dim // 2 :])
            near = [nearest(x, b) for x, b in zip(halves, books)]
            far = [np.linalg.norm(x - b[c], axis=1) for x, b, c in zip(halves, books, near)]
            yield pdf.assign(cell=(near[0] * second + near[1]).astype(np.int32), far_1=far[0], far_2=far[1])

    cells = rows.mapInPandas(coded, "vec_id bigint, label bigint, vector array<bigint>, cell int, far_1 double, far_2 double")
    # at most codes * codes rows
    known = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far_1").alias("far_1"), F.max("far_2").alias("far_2")).toPandas()
    counts, radii = np.zeros(len(books[0]) * second, int), [np.zeros(len(b)) for b in books]
    counts[known["cell"]] = known["n"]
    np.maximum.at(radii[0], known["cell"] // second, known["far_1"])
    np.maximum.at(radii[1], known["cell"] % second, known["far_2"])
    index = Index(books, radii, counts, block)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            yield pd.DataFrame({"block": (index.first[cell] + pdf["turn"].to_numpy() % index.parts[cell]).astype(np.int32), "vec_id": pdf["vec_id"], "label": pdf["label"], "row": [np.asarray(v).astype(kind).tobytes() for v in pdf["vector"]]})

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"block": [key[0]], "ids": [pdf["vec_id"].to_numpy()], "own": [pdf["label"].to_numpy()], "rows": [b"".join(pdf["row"])]})

    turned = cells.select("cell", "vec_id", "label", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(2**31 - 1)).alias("turn"))
    # a block's rows are bounded by its size
    held = checkpointed(turned.mapInPandas(dealt, "block int, vec_id bigint, label bigint, row binary").groupBy("block").applyInPandas(packed, "block int, ids array<bigint>, own array<bigint>, rows binary"))

    anchors = rows.filter(is_anchor)
    no_end = lambda x: F.array(F.lit(float(x)))
    near = searched(index, held, anchors.withColumns({"lows": no_end("-inf"), "highs": no_end("inf")}), kind, True, positives, first)
    near = near.select("anchor_id", (F.col("rank") - 1).alias("part"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    down = lambda x: (x - F.pmod(x, F.lit(100))) / 100  # noqa: E731  exact below 2^53
    windows = near.select("anchor_id", "part", (-down(-low * F.col("positive_score"))).alias("l"), down(high * F.col("positive_score")).alias("h")).filter("l <= h")
    at = lambda c, none: [F.coalesce(F.max(F.when(F.col("part") == n, F.col(c))), F.lit(float(none))) for n in range(positives)]
    state = windows.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array(*at("l", "inf")).alias("lows"), F.array(*at("h", "-inf")).alias("highs"))
    hard = searched(index, held, anchors.join(state, "vec_id"), kind, False, negatives, first)
    out = near.join(hard.select("anchor_id", "part", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "part"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
