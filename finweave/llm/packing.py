"""Best-fit packing of documents into sequences of bounded length."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.llm.shared import bounded, materialise, prefix_sum
from finweave.llm.tokens import encoded

#: Buckets that split sequences of equal gap; at least as many split pieces of
#: equal length: one more for each CELL pieces.
BUCKETS, CELL = 256, 500_000
#: Pieces of which fewer fill a sequence have sequences opened for their own
#: class. (With 6 in place of 3 there are half as many supersteps more, for
#: 0.03 % fewer sequences: then as few as sequential best fit makes.)
CLASSES = 3


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, copy, piece, start, length and ids (binary, little-endian
    unsigned 32 bit) of every document, cut into pieces of ``capacity`` only
    where it is longer. Null texts are empty and still have ``end_id``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, all_ids in encoded(batches, tokenizer, end_id):
            rows = [(d, k // capacity, k, ids[k : k + capacity]) for d, ids in zip(part["doc_id"].to_pylist(), all_ids, strict=True) for k in range(0, len(ids), capacity)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                    "piece": pa.array([r[1] for r in rows], pa.int32()),
                    "start": pa.array([r[2] for r in rows], pa.int64()),
                    "length": pa.array([len(r[3]) for r in rows], pa.int64()),
                    "ids": pa.array([r[3].astype("<u4").tobytes() for r in rows], pa.binary()),
                }
            )

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def to_open(gaps: np.ndarray, left: np.ndarray) -> int:
    """How many sequences to open, given the open sequences by gap and the
    unplaced pieces by length: none while the longest piece fits somewhere.
    Else what pieces of its class (of which as many fill a sequence) need that
    fit nowhere; from CLASSES on, what all need that fit nowhere."""
    capacity = len(left) - 1
    longest, widest = _last(left), _last(gaps)
    if longest <= widest:
        return 0
    fill = capacity // longest
    if fill < CLASSES:
        return -(-int(left[max(widest, capacity // (fill + 1)) + 1 :].sum()) // fill)
    return max(1, int((np.arange(capacity + 1) * left)[widest + 1 :].sum()) // capacity)


def _last(counts: np.ndarray) -> int:
    return int(np.flatnonzero(counts)[-1]) if counts.any() else 0


def depths(gaps: np.ndarray, left: np.ndarray) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Where the sweep of one superstep stands at each size, longest first.

    A gap offers one slot, or, if it holds several of the longest pieces, as
    many. Slots are stacked as the sweep comes down to their size and each
    piece takes the top one: its successor among the gaps that no longer piece
    has taken. Returns (gap, its first slot's level, slots of each, the level
    below which none of them is taken) and (length, level above its first
    piece, pieces that find a slot); a size class of either is a row, so both
    have ``capacity`` rows at most.
    """
    capacity = len(left) - 1
    longest, least = _last(left), int(np.flatnonzero(left)[0])
    depth, events = 0, []
    for size in range(longest, least - 1, -1):
        for gap in range(capacity, size - 1, -1) if size == longest else (size,):
            if gaps[gap]:
                each = max(1, gap // longest)
                events.append((True, gap, depth, each))
                depth += int(gaps[gap]) * each
        n = min(int(left[size]), depth)
        if n:
            events.append((False, size, depth, n))
            depth -= n
    slots, pops, floor = [], [], depth
    for push, size, at, n in reversed(events):
        if push:
            slots.append((size, at, n, floor))
        else:
            pops.append((size, at, n))
            floor = min(floor, at - n)
    return slots, pops


def superstep(state: DataFrame, cells: dict[tuple[int, int], int], ordered: DataFrame, gaps: np.ndarray, left: np.ndarray, done: np.ndarray) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """One superstep, and (length, level, pieces placed) of each length.

    ``state``: the open sequences (seq, gap); ``cells``: how many there are of
    each gap in each bucket; ``ordered``: length and rank of all pieces, of
    which the first ``done`` of each length have their places. The rows are seq
    and slot, the gap that is left then and, of slots that found a piece, its
    length, rank and offset.
    """
    spark, c = state.sparkSession, F.col
    capacity = len(left) - 1
    slots, pops = depths(gaps, left)
    longest = max(x for x, _, _ in pops)
    offered = {gap: (base, each, floor) for gap, base, each, floor in slots}
    held, at = [], dict.fromkeys(offered, 0)
    for (gap, bucket), n in sorted(cells.items()):
        if gap in offered:
            base, each, floor = offered[gap]
            held.append((gap, bucket, base + at[gap] * each, each, floor))
            at[gap] += n
    held = F.broadcast(spark.createDataFrame(held, "gap int, bucket int, base long, each int, floor long"))
    nth = F.row_number().over(Window.partitionBy("gap", "bucket").orderBy("seq")) - 1
    open_ = state.withColumn("bucket", bucket_of(c("seq"))).withColumn("nth", nth).join(held, ["gap", "bucket"]).withColumn("first", c("base") + c("nth") * c("each"))
    # slots that no piece reaches are left out, but for one that carries the sequence on
    low = F.greatest(F.lit(0), F.least((c("floor") - c("first")).cast("int"), c("each") - 1))
    open_ = open_.withColumn("slot", F.explode(F.sequence(low, c("each") - 1)))
    none = F.lit(None)
    offers = open_.select(F.least("gap", F.lit(longest)).alias("size"), (c("first") + c("slot")).alias("level"), none.cast("long").alias("rank"), "seq", "gap", "slot")
    wanted = F.broadcast(spark.createDataFrame([(x, top, n, int(done[x])) for x, top, n in pops], "size int, top long, n long, done long"))
    asked = ordered.filter(c("length").between(min(x for x, _, _ in pops), longest)).select(c("length").alias("size"), "rank").join(wanted, "size").filter((c("rank") >= c("done")) & (c("rank") < c("done") + c("n")))
    asked = asked.select("size", (c("top") - 1 - c("rank") + c("done")).alias("level"), "rank", none.cast("long").alias("seq"), none.cast("int").alias("gap"), none.cast("int").alias("slot"))
    # at one level of the stack slots and pieces take turns, with smaller sizes from pair to pair
    turns = Window.partitionBy("level").orderBy(c("size").desc(), c("rank").isNotNull())
    met = offers.unionByName(asked).withColumn("piece", F.lead(F.struct("size", "rank")).over(turns)).filter("seq is not null")
    met = met.select("seq", "gap", "slot", F.when(c("piece.rank").isNotNull(), c("piece")).alias("piece")).select("seq", "gap", "slot", c("piece.size").alias("length"), "piece.rank")
    whole = Window.partitionBy("seq").orderBy(c("slot").desc())
    before = F.coalesce(F.sum("length").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_ = F.coalesce(F.sum("length").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0))
    return met.select("seq", "slot", "length", "rank", (F.lit(capacity) - c("gap") + before).cast("long").alias("offset"), (c("gap") - all_).cast("int").alias("gap"), (F.row_number().over(whole) == 1).alias("one")), pops


def bucket_of(seq: Column) -> Column:
    """Sequences are numbered as they are opened, so the remainder deals evenly."""
    return F.pmod(seq, F.lit(BUCKETS)).cast("int")


def pack(pieces: DataFrame, capacity: int = 2048, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1..capacity ``length``, by
    bulk-synchronous best fit.

    Pieces are range-sorted by length, with ranks among equal ones, and open
    sequences by gap. A superstep sweeps both from the longest down, as with
    brackets: a gap opens one (or more, if it holds several of the longest
    pieces), a piece closes the nearest open one. Prefix sums over the size
    classes tell how deep the sweep is at each; ranks within a class, counted
    by hash bucket, then tell each slot's and each piece's own level, so pieces
    that want the same gap are parted by rank, and slot and piece meet in a
    window of their level, which holds two rows of a size class at most. Gaps
    are updated and the next superstep takes the pieces left over; sequences
    are opened when the longest of them fits nowhere. The number of supersteps
    depends on the capacity and the spread of lengths, not on how many pieces
    there are; a task holds its share of rows, the driver counts by size class
    and bucket (``capacity`` times BUCKETS at most).

    Repeated rows are packed once each. Rows with null or impossible lengths
    are refused by an error; an empty table packs to an empty one. Columns of
    any names pass through, except that earlier sequence_id and offset give way.
    """
    spark, c = pieces.sparkSession, F.col
    valid = F.when(c("length").between(1, capacity), c("length")).cast("int")
    counts = pieces.groupBy(valid.alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()
    if any(r["length"] is None for r in counts):
        raise ValueError(f"lengths must be 1..{capacity}")
    cols = [x for x in pieces.columns if x.lower() not in ("sequence_id", "offset")]
    left = np.zeros(capacity + 1, np.int64)
    for r in counts:
        left[r["length"]] = r["n"]
    done, total = np.zeros(capacity + 1, np.int64), int(left.sum())
    if not total:
        return pieces.select(*cols, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")).limit(0)
    rows = pieces.select(F.struct(*cols).alias("row"), c("length").cast("int").alias("length"), F.lit(1).cast("long").alias("one"), F.pmod(F.xxhash64(*key), F.lit(max(BUCKETS, total // CELL))).cast("int").alias("piece_bucket"))
    ranked = prefix_sum(rows, ["length"], ["piece_bucket"], [c("row")[k] for k in key], "one", "rank").select("length", "rank", "row")
    ranked = materialise(ranked.repartitionByRange(c("length").desc(), c("rank")).sortWithinPartitions(c("length").desc(), c("rank")), "sorted-pieces")
    state, opened, places = None, 0, []
    gaps, cells = np.zeros(capacity + 1, np.int64), {}
    while True:
        if n := to_open(gaps, left):
            fresh = spark.range(opened, opened + n).select(c("id").alias("seq"), F.lit(capacity).alias("gap"))
            state = fresh if state is None else state.unionByName(fresh)
            for k in range(min(n, BUCKETS)):
                at = (capacity, (opened + k) % BUCKETS)
                cells[at] = cells.get(at, 0) + -(-(n - k) // BUCKETS)
            opened += n
            gaps[capacity] += n
        step, pops = superstep(state, cells, ranked.select("length", "rank"), gaps, left, done)
        step = materialise(step, "superstep")
        places.append(step.filter("rank is not null").select("length", "rank", c("seq").alias("sequence_id"), "offset"))
        for size, _, n in pops:
            left[size] -= n
            done[size] += n
        if not left.any():
            break
        state = step.filter(c("one") & (c("gap") >= int(np.flatnonzero(left)[0]))).select("seq", "gap")
        gaps[:], cells = 0, {}
        for r in state.groupBy("gap", bucket_of(c("seq")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect():
            cells[r["gap"], r["bucket"]] = r["n"]
            gaps[r["gap"]] += r["n"]
    all_ = reduce(DataFrame.unionByName, places)
    return ranked.join(all_, ["length", "rank"]).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place. The ids stay
    out of the shuffles; their crc32 goes along."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialise(pieces, "pieces"), capacity, ("doc_id", "piece", "ids_crc32"))
