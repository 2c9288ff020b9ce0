"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from finweave.llm.shared import bounded, free, hot_keys, materialise, spread_join, working

#: Hash tables; each row is stored once in each.
TABLES = 8
#: What is tried for the other parameters: widths of a cell (vectors have
#: length 1), buckets visited in a table, and projections of a table, up to the
#: binary logarithm of the number of rows.
WIDTHS = (0.5, 1.0, 1.5, 2.0)
PROBES = (1, 2, 4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
PROJECTIONS = (4, 6, 8, 12, 16, 20)
FEWEST, MOST = PROJECTIONS[0], PROJECTIONS[-1]
#: Rows whose neighbours are found exactly to choose among these, rows among
#: which shares are counted, and the share of the neighbours that must be found.
ASKED, COUNTED, RECALL = 64, 2_000, 0.96
#: Rows and queries of one place that a task takes; more are dealt to a grid of tasks.
LOAD, QUERIES = 8_192, 1_024
#: Digits to which fast scores order candidates before they are scored anew.
DIGITS = 12


@dataclass(frozen=True)
class Index:
    """Projections of a table, width of their cells, buckets visited in a
    table, leading projections that name a place (what one task holds), bytes
    of a component, and the recall and the share of rows visited as estimated."""

    projections: int
    width: float
    probes: int
    leading: int
    item: int
    recall: float = 1.0
    share: float = 1.0


def usable(embedding: Column) -> Column:
    """Not null, all components finite numbers, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, fine) & F.exists(embedding, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=64)
def _hashes(dim: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Projections (from a 2-stable, that is normal, distribution) and offsets
    of all tables, and what names their cells: odd multipliers and a start."""
    g = np.random.default_rng([seed, dim])
    a = g.normal(size=(dim, TABLES * MOST)).reshape(dim, TABLES, MOST)[:, :, :projections].reshape(dim, -1)
    offset = g.random(TABLES * MOST).reshape(TABLES, MOST)[:, :projections] * width
    odd = g.integers(1 << 62, size=(TABLES, MOST), dtype=np.int64)[:, :projections] * 2 + 1
    return a, offset, odd, g.integers(1 << 62, size=TABLES, dtype=np.int64)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def projected(x: np.ndarray, index: Index, seed: int) -> np.ndarray:
    """Of vectors in rows: rows x tables x projections, in units of a cell."""
    a, offset, _, _ = _hashes(x.shape[1], index.projections, index.width, seed)
    return ((units(x) @ a).reshape(len(x), TABLES, -1) + offset) / index.width


@lru_cache(maxsize=64)
def order(projections: int, most: int) -> np.ndarray:
    """Sets of cell borders to cross, the likeliest first, as rows of 0 and 1
    over the borders ranked by distance (two a projection). A border's squared
    distance is taken at its expectation for its rank, so the order is the same
    for every query; no set crosses both borders of one projection, which have
    ranks that add up to twice the projections, less one."""
    m = projections
    j = np.arange(1, 2 * m + 1)
    k = 2 * m + 1 - j
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2)))
    out = [np.zeros(2 * m, np.int8)]
    heap: list[tuple[float, tuple[int, ...]]] = [(float(cost[0]), (0,))]
    while heap and len(out) < most:
        at, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - x in chosen for x in chosen):
            row = np.zeros(2 * m, np.int8)
            row[list(chosen)] = 1
            out.append(row)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (at - float(cost[last]) + float(cost[last + 1]), (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (at + float(cost[last + 1]), (*chosen, last + 1)))
    return np.array(out)


def probes(at: np.ndarray, most: int) -> np.ndarray:
    """The buckets of a table in order of estimated success, as steps to
    neighbouring cells (rows of -1, 0, 1) from that of ``at``."""
    m = len(at)
    low = at - np.floor(at)
    borders = np.concatenate([low, 1 - low])  # below, above
    rank = np.argsort(borders, kind="stable")
    # equal distances would break the mirrored ranks that ``order`` relies on
    rank = np.concatenate([rank[:m], (rank[:m][::-1] + m) % (2 * m)])
    sets = order(m, most)
    steps = np.zeros((len(sets), 2 * m), np.int64)
    steps[:, rank] = sets
    return steps[:, m:] - steps[:, :m]


def _matrix(raws: list[bytes], item: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), f"<f{item}").reshape(len(raws), -1).astype(np.float64)


def by_length(raws: list[bytes]) -> dict[int, np.ndarray]:
    lens = np.fromiter(map(len, raws), np.int64, len(raws))
    return {int(n): np.flatnonzero(lens == n) for n in np.unique(lens)}


def _names(cells: np.ndarray, odd: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (cells[..., :n] * odd[:, :n]).sum(-1) + start + n


def stored_rows(df: DataFrame, index: Index, seed: int) -> DataFrame:
    """place, bucket, id and vector: each row under its bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("ann")
        for batch in batches:
            raws, ids = batch["vector"].to_pylist(), batch["id"].to_numpy()
            for some in by_length(raws).values():
                for at in np.array_split(some, -(-len(some) // 2_000)):
                    mine = [raws[i] for i in at]
                    x = _matrix(mine, index.item)
                    _, _, odd, start = _hashes(x.shape[1], index.projections, index.width, seed)
                    cells = np.floor(projected(x, index, seed)).astype(np.int64)
                    for t in range(TABLES):
                        c = cells[:, t : t + 1]
                        place, bucket = (_names(c, odd[t : t + 1], start[t : t + 1], n)[:, 0] for n in (index.leading, index.projections))
                        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(bucket), pa.array(ids[at]), pa.array(mine, pa.binary())], names=["place", "bucket", "id", "vector"])

    return df.select("id", "vector").mapInArrow(run, "place long, bucket long, id long, vector binary")


def visiting(df: DataFrame, index: Index, seed: int) -> DataFrame:
    """place, id, vector and wanted (the buckets to visit there, sorted, as
    bytes of 64-bit numbers) of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("ann")
        for batch in batches:
            for i, raw in zip(batch["id"].to_pylist(), batch["vector"].to_pylist(), strict=True):
                x = _matrix([raw], index.item)
                _, _, odd, start = _hashes(x.shape[1], index.projections, index.width, seed)
                at = projected(x, index, seed)[0]
                places, wanted = [], []
                for t in range(TABLES):
                    cells = np.floor(at[t]).astype(np.int64) + probes(at[t], index.probes)
                    place, bucket = (_names(cells[:, None], odd[t : t + 1], start[t : t + 1], n)[:, 0] for n in (index.leading, index.projections))
                    for p in np.unique(place):
                        places.append(int(p))
                        wanted.append(np.unique(bucket[place == p]).astype("<i8").tobytes())
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([i] * n, pa.int64()), pa.array([raw] * n, pa.binary()), pa.array(wanted, pa.binary())], names=["place", "id", "vector", "wanted"])

    return df.select("id", "vector").mapInArrow(run, "place long, id long, vector binary, wanted binary")


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In double precision, the same for the same vectors wherever they stand."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


FOUND = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _nearest(q: int, v: np.ndarray, x: np.ndarray, fast: np.ndarray, own: np.ndarray, at: np.ndarray, k: int, out: tuple[list, list, list]) -> None:
    """The k best of the rows ``at`` by exact score, told apart by rounded fast ones."""
    fast = np.round(fast, DIGITS)
    if len(fast) > k:
        keep = np.flatnonzero(fast >= np.partition(fast, -k)[-k] - 2 * 10.0**-DIGITS)
        at = at[keep]
    exact = sorted((-cosine(v, x[i]), int(own[i])) for i in at)
    for s, i in exact[:k]:
        out[0].append(q)
        out[1].append(i)
        out[2].append(-s)


def _scored(k: int, item: int):
    """Of one place (or block): for each query the k nearest of the rows in the
    buckets it wants (all, if it names none), exactly scored."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        working("ann")
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and queries.num_rows:
            raws, asked, ids = rows["vector"].to_pylist(), queries["vector"].to_pylist(), rows["id"].to_numpy()
            buckets = rows["bucket"].to_numpy()
            wanted, names = queries["wanted"].to_pylist(), queries["id"].to_pylist()
            there = by_length(raws)
            for n, mine in by_length(asked).items():
                if n not in there:
                    continue
                at = there[n][np.argsort(buckets[there[n]], kind="stable")]
                x, own, b = _matrix([raws[i] for i in at], item), ids[at], buckets[at]
                unit = units(x)
                ys = _matrix([asked[j] for j in mine], item)
                for j, v, u in zip(mine, ys, units(ys), strict=True):
                    if wanted[j] is None:
                        pick = np.arange(len(own))
                    else:
                        want = np.frombuffer(wanted[j], "<i8")
                        low = np.searchsorted(b, want)
                        size = np.searchsorted(b, want, "right") - low
                        pick = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                    if len(pick):
                        _nearest(names[j], v, x, unit[pick] @ u, own, pick, k, out)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dealt(rows: DataFrame, queries: DataFrame, k: int, item: int) -> DataFrame:
    """Rows (place, bucket, id, vector) and queries (place, id, vector, wanted),
    both written, meet at their places; a place with many of either is a grid
    of tasks, each with its part of both. The lists of such places are broadcast,
    within the bound of ``hot_keys``."""
    many = F.broadcast(materialise(hot_keys(rows, ["place"], least=LOAD), "places"))
    much = F.broadcast(materialise(hot_keys(queries, ["place"], least=QUERIES), "places"))
    grid = lambda df: df.join(many.withColumnRenamed("__parts", "of"), "place", "left").join(much.withColumnRenamed("__parts", "qs"), "place", "left").withColumns({"of": F.coalesce("of", F.lit(1)), "qs": F.coalesce("qs", F.lit(1))})
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = grid(rows).withColumn("i", part(F.col("of"))).withColumn("j", all_(F.col("qs"))).drop("of", "qs")
    two = grid(queries).withColumn("j", part(F.col("qs"))).withColumn("i", all_(F.col("of"))).drop("of", "qs")
    return one.groupBy("place", "i", "j").cogroup(two.groupBy("place", "i", "j")).applyInArrow(_scored(k, item), FOUND)


def in_blocks(rows: DataFrame, queries: DataFrame, k: int, item: int) -> DataFrame:
    """Exact search: the queries against all rows, both in blocks."""
    blocks, lots = max(1, rows.count() // LOAD), max(1, queries.count() // QUERIES)
    dealt = lambda df, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = rows.select("id", "vector", F.lit(0).cast("long").alias("bucket"), dealt(rows, blocks).alias("i")).withColumn("j", every(lots))
    two = queries.select("id", "vector", F.lit(None).cast("binary").alias("wanted"), dealt(queries, lots).alias("j")).withColumn("i", every(blocks))
    return _merged(one.groupBy("i", "j").cogroup(two.groupBy("i", "j")).applyInArrow(_scored(k, item), FOUND), k)


def fit(rows: DataFrame, k: int, item: int, seed: int) -> Index:
    """Chooses projections, width and probes from bounded samples: the exact
    neighbours, among all rows, of ASKED rows tell which settings find RECALL
    of them, COUNTED rows tell which of these visits least. (Samples are the
    rows of least hash, so the same rows give the same index.)"""
    some = rows.withColumn("h", F.xxhash64("id", F.lit(seed))).orderBy("h", "id").limit(COUNTED).select("id", "vector").collect()
    n = rows.count()
    asked = rows.sparkSession.createDataFrame([(r["id"], bytes(r["vector"])) for r in some[:ASKED]], "id long, vector binary").dropDuplicates(["id"])
    truth = in_blocks(rows, asked, k + 1, item).filter("query_id != vec_id and rank <= %d" % (k + 1)).select("query_id", "vec_id")
    near = truth.join(rows, F.col("vec_id") == F.col("id")).select("query_id", "vector").collect()
    around: dict[int, list[bytes]] = {}
    for r in near:
        around.setdefault(r["query_id"], []).append(bytes(r["vector"]))
    counted = [bytes(r["vector"]) for r in some]
    log_n = max(1.0, math.log2(max(2, n)))
    best = None
    for m in (x for x in PROJECTIONS if x <= max(FEWEST, round(log_n))):
        for width in WIDTHS:
            trial = Index(m, width, PROBES[-1], m, item)
            found, seen, pairs, rows_seen = np.zeros(len(PROBES)), np.zeros(len(PROBES)), 0, 0
            for r in some[:ASKED]:
                q = bytes(r["vector"])
                mine = [x for x in around.get(r["id"], []) if len(x) == len(q)]
                others = [x for x in counted if len(x) == len(q)]
                if not mine:
                    continue
                first = _first_probe(_matrix([q], item), _matrix(mine + others, item), trial, seed)
                for j, p in enumerate(PROBES):
                    found[j] += (first[: len(mine)] < p).sum()
                    seen[j] += (first[len(mine) :] < p).sum()
                pairs += len(mine)
                rows_seen += len(others)
            if not pairs:
                continue
            for j, p in enumerate(PROBES):
                recall, share = found[j] / pairs, seen[j] / rows_seen
                # a probe costs about as much as four candidates
                key = (min(recall, RECALL), -(share * n + 4 * TABLES * p))
                if best is None or key > best[0]:
                    best = (key, m, width, p, recall, share)
    if best is None:
        return Index(FEWEST, WIDTHS[-1], PROBES[-1], 0, item)
    _, m, width, p, recall, share = best
    cells = max(1.5, 4.13 / width)  # as good as so many equal cells a projection
    leading = min(m, max(0, math.ceil(math.log(max(1.0, n / LOAD)) / math.log(cells))))
    return Index(m, width, p, leading, item, float(recall), float(share))


def _first_probe(q: np.ndarray, x: np.ndarray, index: Index, seed: int) -> np.ndarray:
    """For each row the least place, over all tables, of its bucket in the
    query's order of visits; the number of probes, if none visits it."""
    at, there = projected(q, index, seed)[0], np.floor(projected(x, index, seed)).astype(np.int64)
    out = np.full(len(x), index.probes)
    three = 3 ** np.arange(index.projections, dtype=np.int64)
    for t in range(TABLES):
        steps = probes(at[t], index.probes)
        code = ((steps + 1) * three).sum(1)
        by = np.argsort(code)
        gap = there[:, t] - np.floor(at[t]).astype(np.int64)
        near = np.flatnonzero(np.abs(gap).max(1) <= 1)
        mine = ((gap[near] + 1) * three).sum(1)
        k = np.minimum(np.searchsorted(code[by], mine), len(code) - 1)
        hit = code[by][k] == mine
        out[near[hit]] = np.minimum(out[near[hit]], by[k[hit]])
    return out


def prepared(df: DataFrame, item: int) -> DataFrame:
    """id, vector (little-endian components of ``item`` bytes) and key (its digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(f"<f{item}").tobytes()
            at = (b["embedding"].offsets.to_numpy().astype(np.int64) - b["embedding"].offsets[0].as_py()) * item
            raw = [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(raw, pa.binary()), pa.array([hashlib.md5(r).digest() for r in raw], pa.binary())], names=["id", "vector", "key"])

    return df.mapInArrow(run, "id long, vector binary, key binary")


def search(vectors: DataFrame, is_query: Column, k: int = 5, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine found for every
    row that is a query, among all other rows (vec_id, embedding).

    Equal vectors are one: of rows with the same vector only the k + 1 least
    ids can be among the k nearest of any query, and queries with the same
    vector share an answer, so a vector that a third of all rows have is a few
    rows. Rows are stored under one bucket a table; queries visit buckets in
    order of estimated success, as many and as fine ones as ``fit`` finds
    necessary for this data, and score exactly what is in them. Buckets lie in
    places by their leading projections; a place beyond LOAD rows or QUERIES
    queries is a grid of tasks. A query that finds too few is answered exactly,
    in blocks. Vectors that are null, zero or hold null or non-finite
    components, and null vec_ids, take no part; vectors of other lengths are no
    candidates. Repeated rows of a vec_id count as one candidate. Ties go to
    the smaller vec_id; an empty table gives no rows.
    """
    c, more = F.col, k + 1
    item = 4 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else 8
    mark = free(vectors, "__asks")
    good = bounded(vectors).filter(usable(c("embedding")) & c("vec_id").isNotNull()).withColumn(mark, F.coalesce(is_query, F.lit(False)))
    kind = "array<float>" if item == 4 else "array<double>"
    part = lambda df: prepared(df.select(c("vec_id").cast("long").alias("id"), c("embedding").cast(kind).alias("embedding")), item)
    least_ids = Window.partitionBy("key").orderBy("id")
    once = part(good).dropDuplicates(["key", "id"]).withColumn("nth", F.row_number().over(least_ids)).filter(c("nth") <= more)
    rows = materialise(once.select("id", "vector"), "vectors")
    asks = materialise(part(good.filter(mark)).dropDuplicates(["key", "id"]), "asked")
    asked = materialise(asks.groupBy("key").agg(F.min("id").alias("id"), F.first("vector").alias("vector")), "questions")
    index = fit(rows, k, item, seed)
    stored = materialise(stored_rows(rows, index, seed), "buckets")
    visits = materialise(visiting(asked, index, seed), "visits")
    merged = materialise(_merged(_dealt(stored, visits, more, item), more), "nearest")
    enough = merged.groupBy("query_id").count().filter(c("count") >= more).select(c("query_id").alias("done"))
    few = materialise(asked.join(enough, c("id") == c("done"), "left_anti"), "few")
    if not few.isEmpty():
        rest = materialise(in_blocks(rows, few.select("id", "vector"), more, item), "exact")
        merged = merged.join(few.select(c("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    # one answer goes to all queries of its vector, each without itself
    answers = merged.join(asked.select(c("id").alias("query_id"), "key"), "query_id").select("key", "vec_id", "score")
    each = spread_join(asks.select("key", c("id").alias("query_id")), answers, ["key"], ["query_id"]).filter("vec_id != query_id")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(c("score").desc(), "vec_id"))
    best = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a vec_id may have several vectors
    return best.withColumn("rank", nth).filter(c("rank") <= k).select("query_id", "rank", "vec_id", "score")
