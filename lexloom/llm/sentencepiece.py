"""SentencePiece encoding and decoding as a relational lattice.

Texts fall into units: a run of blanks and the word after it. No piece crosses
a unit's end, so units are independent, and distinct units become lattices:
their substrings of at most the longest piece's length are exploded, equi-joined
with the piece table, grouped by unit, and folded to the cheapest path with the
higher-order aggregate. Characters that no piece covers become byte pieces, so
that every text decodes to itself. Long units are folded in chunks that carry
the last states, so that a path doesn't depend on any length. The paths then go
back to the texts: those of frequent units in files that Spark hands to every executor, the others
by a join.

A piece costs the negated log-probability of its rank by the law of Zipf and
Mandelbrot, 1 / (rank + SHIFT), in thousandths of a nat: the given model holds merge
ranks, which are no log-probabilities themselves, and nothing is trained here. Equal costs go to the shorter last piece, then to the smaller id.
For a model of log-probabilities pass costs="scores".

Defined cases: a null text has no pieces; an empty text is the blank alone;
repeated rows get a row each; an empty table gives no rows; further columns
stay, but for those named piece_ids, n_pieces and decoded, which are replaced.
Units and pieces are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed, dropped, fresh, let, setting

MARK = "▁"
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: An edge is one number: its cost, its length (6 bits) and its id (22 bits).
LEN_AT, COST_AT = 22, 28
#: Ids from here on stand for characters that no piece covers, until they become bytes.
CHAR = 1 << 21
#: Of the costs; among 50 to 3,000 the one whose paths most often equal the model's own merges.
SHIFT = 200
#: Ends folded at once, and states carried on from them.
CHUNK, CARRIED = 256, 64
#: Units and slots of hashes placed at once.
AT_ONCE = 1 << 16
FIELDS = ("h", "sizes", "ids")


class Pieces:
    """A model's pieces: a table (key, edge) for the lattice, and what each id decodes to."""

    def __init__(self, spark: SparkSession, model: str = MODEL, costs: str = "zipf"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        rows = sorted((-sp.get_score(i), i, sp.id_to_piece(i).replace(MARK, " ")) for i in range(sp.get_piece_size()) if not special(i))
        harmonic = math.log(sum(1 / (r + SHIFT) for r in range(1, len(rows) + 1)))
        cost = lambda r, s: round(1000 * (math.log(r + SHIFT) + harmonic if costs == "zipf" else s))
        priced = [(p, i, cost(r, s)) for r, (s, i, p) in enumerate(rows, 1)]
        self.longest = max(len(p) for p, _, _ in priced)
        if self.longest >= CARRIED or sp.get_piece_size() > CHAR:
            raise ValueError("pieces are shorter than 64 characters, and at most 2,097,152")
        self.zero, self.worst = sp.piece_to_id("<0x00>"), max(c for _, _, c in priced)
        named = spark.createDataFrame([(p, (c << COST_AT) + (len(p) << LEN_AT) + i) for p, i, c in priced], "piece string, edge bigint")
        self.table = named.select(F.xxhash64("piece").alias("key"), "edge")
        texts = {i: p for p, i, _ in priced}
        size = sp.get_piece_size()
        hexed = [f"{i - self.zero:02X}" if self.zero <= i < self.zero + 256 else texts.get(i, "").encode().hex().upper() for i in range(size)]
        self.spelled = pa.array([bytes.fromhex(x) for x in hexed], pa.binary())
        self.decoding = spark.createDataFrame([([texts.get(i, "") for i in range(size)], hexed)], "texts array<string>, hexed array<string>")


def units(text: Column) -> Column:
    """The units of a text, each without its first blank, which all units have."""
    plain = ~(F.contains(text, F.lit("  ")) | F.startswith(text, F.lit(" ")))
    return F.when(plain, F.split(text, " ", -1)).otherwise(F.split(text, "(?<=[^ ]) ", -1))


def length_of(edge: Column) -> Column:
    return F.shiftright(edge, LEN_AT).bitwiseAND(F.lit(63)).cast("int")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h and its edges by their ends; the rows of a unit follow each other in the order of ends, the shortest edge first."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out(h: np.ndarray, edge: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        ends = np.flatnonzero((edge >> LEN_AT) & 63 == 1)
        inner = pa.ListArray.from_arrays(pa.array(np.append(ends, len(edge)), pa.int32()), pa.array(edge))
        outer = pa.ListArray.from_arrays(pa.array(np.searchsorted(ends, np.append(starts, len(edge))), pa.int32()), inner)
        return pa.RecordBatch.from_arrays([pa.array(h[starts]), outer], names=["h", "edges"])

    for batch in batches:
        h, end, edge = (batch.column(k).to_numpy() for k in range(3))
        starts = np.flatnonzero(end == 1)
        if not len(starts):
            held.append((h, edge))
            continue
        held.append((h[: starts[-1]], edge[: starts[-1]]))
        whole_h, whole_edge = (np.concatenate([x[k] for x in held]) for k in range(2))
        if len(whole_h):
            before = len(whole_h) - starts[-1]
            own = starts[:-1] + before
            yield out(whole_h, whole_edge, own if not before else np.concatenate([[0], own]))
        held = [(h[starts[-1] :], edge[starts[-1] :])]
    if held and sum(len(x[0]) for x in held):
        yield out(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.zeros(1, np.int64))


def lattices(words: DataFrame, pieces: Pieces) -> DataFrame:
    """h and edges (for each end, the edges that end there) of words (h, w)."""
    unit = F.concat(F.lit(" "), "w")
    ends = words.select("h", unit.alias("u"), F.explode(F.sequence(F.lit(1), F.length(unit))).alias("end"))
    subs = ends.select("h", "u", "end", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), "end"))).alias("len"))
    subs = subs.select("h", "end", "len", F.substring("u", F.col("end") - F.col("len") + 1, F.col("len")).alias("sub")).withColumn("key", F.xxhash64("sub"))
    # the piece table is one model's vocabulary
    joined = subs.join(F.broadcast(pieces.table), "key", "left").filter("edge is not null or len = 1")
    unknown = F.shiftleft((F.octet_length("sub") * (pieces.worst + 10_000)).cast("long"), COST_AT) + (1 << LEN_AT) + CHAR + F.ascii("sub")
    rows = joined.select("h", "end", F.coalesce("edge", unknown).alias("edge"))
    return rows.mapInArrow(gathered, "h bigint, edges array<array<bigint>>")


def cheapest(edges: Column) -> Column:
    """For each end the edge of the cheapest path to it, with that path's cost."""

    def step(acc: Column, here: Column) -> Column:
        before = lambda x: F.get(acc, F.size(acc) - length_of(x))
        tried = F.transform(here, lambda x: x + F.shiftleft(F.shiftright(before(x), COST_AT), COST_AT))
        return F.concat(acc, F.array(F.array_min(tried)))

    origin = F.array(F.lit(0).cast("long"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(edges) - 1) / CHUNK).cast("int")), lambda k: F.slice(edges, k * CHUNK + 1, F.lit(CHUNK)))

    def chunk(state: Column, some: Column) -> Column:
        folded = F.aggregate(some, state["last"], step)
        last = lambda acc: F.slice(acc, F.greatest(F.size(acc) - CARRIED + 1, F.lit(1)), F.lit(CARRIED))
        return let(folded, lambda acc: F.struct(last(acc).alias("last"), F.concat(state["done"], F.array(F.slice(acc, F.size(state["last"]) + 1, F.lit(CHUNK)))).alias("done")))

    start = F.struct(origin.alias("last"), F.array().cast("array<array<bigint>>").alias("done"))
    long = F.aggregate(chunks, start, chunk, lambda s: F.flatten(s["done"]))
    return F.when(F.size(edges) <= CHUNK, F.slice(F.aggregate(edges, origin, step), 2, 2**30)).otherwise(long)


def followed(batches: Iterator[pa.RecordBatch], zero: int) -> Iterator[pa.RecordBatch]:
    """h and the piece ids of each cheapest path, followed back from the last end for a whole batch at once."""
    for batch in batches:
        best, sizes = flat_lists(batch.column(1))
        first = np.cumsum(sizes) - sizes
        row, at, steps = np.arange(len(sizes)), sizes.astype(np.int64), []
        while len(row):
            edge = best[first[row] + at - 1]
            steps.append((row, edge & ((1 << LEN_AT) - 1)))
            at = at - ((edge >> LEN_AT) & 63)
            row, at = row[at > 0], at[at > 0]
        rows = np.concatenate([x for x, _ in steps[::-1]]) if steps else np.empty(0, np.int64)
        ids = np.concatenate([x for _, x in steps[::-1]]) if steps else np.empty(0, np.int64)
        order = np.argsort(rows, kind="stable")
        rows, ids = rows[order], ids[order]
        strange = np.flatnonzero(ids >= CHAR)
        if len(strange):  # characters that no piece covers become their bytes
            made = [np.frombuffer(chr(i - CHAR).encode(), np.uint8).astype(np.int64) + zero for i in ids[strange].tolist()]
            n = np.ones(len(ids), np.int64)
            n[strange] = [len(x) for x in made]
            rows, ids = np.repeat(rows, n), np.repeat(ids, n)
            ids[np.repeat(np.isin(np.arange(len(n)), strange), n)] = np.concatenate(made)
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(sizes)))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names=["h", "ids"])


def decoded(ids: Column, texts: Column, hexed: Column, raw: Column) -> Column:
    """The text that ids stand for; texts and hexed have the pieces by id, and raw tells whether there are byte pieces."""
    join = lambda names: F.array_join(F.transform(ids, lambda i: F.get(names, i)), "")
    return F.substring(F.when(raw, F.decode(F.unhex(join(hexed)), "UTF-8")).otherwise(join(texts)), 2, 2**31 - 1)


def decode(coded: DataFrame, ids_col: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """coded with decoded, the text that its ids give; the pieces are one row, looked up by id."""
    pieces = Pieces(coded.sparkSession, model)
    a, b = fresh(coded, "piece_texts", "piece_hexed")
    met = coded.crossJoin(F.broadcast(pieces.decoding.toDF(a, b)))  # one row
    raw = F.exists(ids_col, lambda i: (i >= pieces.zero) & (i < pieces.zero + 256))
    return met.withColumn("decoded", decoded(F.col(ids_col), F.col(a), F.col(b), raw)).drop(a, b)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, ids) of a partition as one row of numbers: hashes, lengths, ids."""
    batches = list(batches)
    if batches:
        h = np.concatenate([x.column(0).to_numpy() for x in batches])
        ids, sizes = (np.concatenate(x) for x in zip(*(flat_lists(x.column(1)) for x in batches), strict=True))
        sizes, ids = (x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (sizes, ids))
        row = [h.tobytes(), sizes.itemsize, sizes.tobytes(), ids.itemsize, ids.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["h", "a", "sizes", "b", "ids"])


class Paths:
    """Units' hashes in order, with the places of their ids (starts) and where each slot of hashes begins (slots), both made from what the files hold."""

    def __init__(self, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        self.h, self.ids = h, ids
        self.starts = np.zeros(len(sizes) + 1, np.uint32)
        bits = slot_bits(len(h))
        self.slots = np.empty(1 << bits, np.uint32)
        # a part at a time: every worker has arrays of its own
        for at in range(0, len(sizes), AT_ONCE):
            self.starts[at + 1 : at + AT_ONCE + 1] = self.starts[at] + np.cumsum(sizes[at : at + AT_ONCE], dtype=np.uint32)
        for at in range(0, len(self.slots), AT_ONCE):
            own = np.arange(at, min(at + AT_ONCE, len(self.slots))) - (1 << (bits - 1))
            self.slots[at : at + AT_ONCE] = np.searchsorted(h, own << (64 - bits))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether there)."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = self.slots[slot_of(h, len(self.h))].astype(np.int64)
        ahead = np.arange(len(h))
        while len(ahead):  # a slot has a few hashes
            ahead = ahead[at[ahead] < len(self.h)]
            ahead = ahead[self.h[at[ahead]] < h[ahead]]
            at[ahead] += 1
        at = np.minimum(at, len(self.h) - 1)
        return at, self.h[at] == h


def slot_bits(units: int) -> int:
    return max(units.bit_length() - 2, 1)


def slot_of(h: np.ndarray, units: int) -> np.ndarray:
    """The leading bits of hashes, two to four units a slot."""
    bits = slot_bits(units)
    return (h >> (64 - bits)) + (1 << (bits - 1))


def shipped(coded: DataFrame) -> str:
    """The name under which Spark hands the paths of these units to every executor, as files."""
    # one partition after another, some 16 bytes a unit
    rows = list(coded.mapInArrow(packed, "h binary, a bigint, sizes binary, b bigint, ids binary").toLocalIterator())
    gather = lambda name, width: np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(r[name], f"u{r[width]}") for r in rows)])
    h = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["h"], np.int64) for r in rows)])
    sizes = gather("sizes", "a")
    ids = gather("ids", "b")
    del rows
    order = np.argsort(h).astype(np.uint32)
    ordered = h[order]
    del h
    counts = sizes[order]
    before = (np.cumsum(sizes, dtype=np.uint32) - sizes)[order]
    del sizes
    placed, at = np.empty_like(ids), 0
    for k in range(0, len(order), 500_000):
        n = counts[k : min(k + 500_000, len(order))].astype(np.int64)
        ends = np.cumsum(n)
        placed[at : at + int(ends[-1])] = ids[np.repeat(before[k : k + len(n)].astype(np.int64) - (ends - n), n) + np.arange(int(ends[-1]))]
        at += int(ends[-1])
    sc, name = coded.sparkSession.sparkContext, f"paths-{uuid.uuid4().hex}"
    for field, a in zip(FIELDS, (ordered, counts, placed), strict=True):
        file = os.path.join(SparkFiles.getRootDirectory(), f"{name}-{field}.npy")  # the application's own folder
        np.save(file, a)
        sc.addFile(file)
    return name


#: The paths that this worker asked last.
_opened: dict[str, Paths] = {}


def opened(name: str) -> Paths:
    """The paths in this executor's files, mapped: its Python workers share one copy. Earlier ones go first."""
    if name not in _opened:
        _opened.clear()
        _opened[name] = Paths(*(np.asarray(np.load(SparkFiles.get(f"{name}-{field}.npy"), mmap_mode="r")) for field in FIELDS))
    return _opened[name]


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths); null lists have length 0."""
    return lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()


def in_parts(known: Paths, hashes: pa.Array, own: pa.Array | None, spelled: pa.Array, most: int = 100_000) -> pa.Array:
    """joined_ids of some lists at a time, of at most `most` units together as far as one list has no more."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(hashes), 0).to_numpy())
    out, at = [], 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        out.append(joined_ids(known, hashes.slice(at, to - at), None if own is None else own.slice(at, to - at), spelled))
        at = to
    return pa.concat_arrays(out) if out else joined_ids(known, hashes, own, spelled)


def joined_ids(known: Paths, hashes: pa.Array, own: pa.Array | None, spelled: pa.Array) -> pa.Array:
    """ids of each list of units, and the text that they give by what each id spells; own has the units (h, ids) that known lacks."""
    h, sizes = flat_lists(hashes)
    at, there = known.find(h)
    n, start, more = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.empty(0, np.int32)
    if len(known.h):
        start = known.starts[at].astype(np.int64)
        n = known.starts[at + 1] - start
    if not there.all():
        extra = own.flatten()
        more, counts = flat_lists(extra.field("ids"))
        keys, first = extra.field("h").to_numpy(), np.cumsum(counts) - counts
        order = np.argsort(keys, kind="stable")
        place = order[np.searchsorted(keys[order], h[~there])]
        n[~there], start[~there] = counts[place], first[place]
    ends = np.cumsum(n)
    spot = np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    if there.all():
        got = np.asarray(known.ids[spot], np.int32)
    else:
        held, got = np.repeat(there, n), np.empty(len(spot), np.int32)
        got[held], got[~held] = known.ids[spot[held]], more[spot[~held]]
    rows = np.concatenate([[0], np.cumsum(sizes)])
    offsets = np.concatenate([[0], ends])[rows]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(got), mask=hashes.is_null() if hashes.null_count else None)
    texts = spelled_out(got, offsets, spelled)
    return pa.StructArray.from_arrays([lists, pc.if_else(hashes.is_valid(), texts, None) if hashes.null_count else texts], names=["ids", "decoded"])


def spelled_out(ids: np.ndarray, offsets: np.ndarray, spelled: pa.Array) -> pa.Array:
    """The text of each run of ids, less the blank that it begins with."""
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(spelled).to_numpy()[ids], dtype=np.int64)])[offsets]
    some = np.diff(bounds) > 0
    data = np.frombuffer(spelled.take(pa.array(ids)).buffers()[2] or b"", np.uint8)[: bounds[-1]]
    bounds[1:] -= np.cumsum(some)
    firsts = np.flatnonzero(some)
    data = np.delete(data, bounds[firsts] + np.arange(len(firsts)))
    return pa.StringArray.from_buffers(len(some), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, costs: str = "zipf", head_words: int = 6_000_000, max_batch: int = 1_000) -> DataFrame:
    """The documents with piece_ids, n_pieces and decoded (the text that the ids give back).

    The paths of the most frequent units, at most head_words (some 20 bytes
    each), go to every executor as files; the others reach their texts by a join. Texts are long
    rows: the session's Arrow batches are set to max_batch rows at most.
    """
    spark = docs.sparkSession
    pieces = Pieces(spark, model, costs)
    counts = docs.filter(F.col(text_col).isNotNull()).select(F.explode(units(F.col(text_col))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    counts = checkpointed(counts.select(F.xxhash64("w").alias("h"), "w", "k"))
    folded, zero = lattices(counts, pieces).select("h", cheapest(F.col("edges")).alias("best")), pieces.zero
    # edges are rows of three numbers: with a limit of bytes, Spark adds up a batch's bytes anew for each of them
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", 2**31 - 1):
        coded = checkpointed(folded.mapInArrow(lambda batches: followed(batches, zero), "h bigint, ids array<int>"))

    # counts by frequency: at most 10,000 numbers reach the driver
    histogram = counts.groupBy(F.least("k", F.lit(10_000)).alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).collect()
    cut, taken = 10_001, 0
    for row in histogram:
        if taken + row["n"] > head_words:
            break
        cut, taken = row["k"], taken + row["n"]
    all_known = not histogram or cut == histogram[-1]["k"]
    head = coded if all_known else coded.join(counts.filter(F.col("k") >= cut).select("h"), "h", "left_semi")
    shared = shipped(head)  # at most head_words
    dropped(counts)

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows, min(max_batch, int(spark.conf.get(rows)) if int(spark.conf.get(rows)) > 0 else max_batch))
    key, mark, hashes, own, k, m, got = fresh(docs, "piece_doc", "piece_text", "piece_units", "piece_own", "piece_k", "piece_m", "piece_got")
    made = F.transform(units(F.col(text_col)), lambda u: F.xxhash64(u))
    out, spelled = docs.withColumn(hashes, made), pieces.spelled
    if all_known:
        dropped(coded)  # the files have it all

        @F.arrow_udf("ids array<int>, decoded string")
        def looked_up(lists: pa.Array) -> pa.Array:
            return in_parts(opened(shared), lists, None, spelled)

        ids = looked_up(F.col(hashes))
    else:
        out = out.withColumn(key, F.col(id_col).cast("string")).withColumn(mark, F.xxhash64(F.col(text_col)))

        def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, sizes = flat_lists(batch.column(2))
                row = np.repeat(np.arange(len(sizes)), sizes)[~opened(shared).find(h)[1]]
                h = h[~opened(shared).find(h)[1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(h)], names=["i", "m", "h"])

        places = out.filter(F.col(text_col).isNotNull()).select(key, mark, hashes).mapInArrow(missing, "i string, m bigint, h bigint").distinct()
        tails = places.join(coded, "h").groupBy("i", "m").agg(F.collect_list(F.struct("h", "ids")).alias("own"))  # a text's own rare units
        tails = checkpointed(tails)
        dropped(coded)
        tails = tails.select(F.col("i").alias(k), F.col("m").alias(m), F.col("own").alias(own))
        out = out.join(tails, F.col(key).eqNullSafe(F.col(k)) & F.col(mark).eqNullSafe(F.col(m)), "left")

        @F.arrow_udf("ids array<int>, decoded string")
        def looked_up(lists: pa.Array, rare: pa.Array) -> pa.Array:
            return in_parts(opened(shared), lists, rare, spelled)

        ids = looked_up(F.col(hashes), F.col(own))
    out = out.withColumn(got, ids).withColumn("piece_ids", F.col(got)["ids"]).withColumn("n_pieces", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long"))
    out = out.withColumn("decoded", F.col(got)["decoded"])
    return out.drop(hashes, own, key, mark, k, m, got)
