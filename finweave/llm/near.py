"""Near duplicates: consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.llm.graph import components
from finweave.llm.shared import bounded, free, hot_keys, materialise, spread_join, working
from finweave.llm.tokens import steps

SHINGLE = 5
#: BANDS bands of ROWS samples: a pair of similarity 0.8 meets with chance 0.9994.
BANDS, ROWS = 14, 4
#: Counters of document frequencies, the slices they are added up in, and how many go into one sum.
COUNTERS, SLICES, FAN = 1 << 20, 16, 64
#: How much heavier than a shingle of all documents a rare one is, at most.
IDF_GAIN = 0.25
#: Weights are rounded to steps of e^(1/32) for sampling (not for verifying).
LEVELS, STEP = 112, 32
#: Entries of the table that the random numbers come from, by 16 hashed bits.
ENTRIES = 1 << 16
#: Buckets up to this size are compared within; larger ones by leaders, then in blocks.
SMALL = 32
#: Most nodes and characters (on average) of one side of a comparison of blocks.
BLOCK, BLOCK_CHARS = 1024, 4_000_000
#: Pairs of single features that a step of a comparison takes, to bound its memory.
PAIRS = 400_000
#: Similarities nearer to the least one than this are computed again in double precision.
MARGIN = 1e-3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (lower-cased runs of letters and digits) of
    the texts in a row, and the texts' borders."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pM\pN]+", " ")
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
    coded = split.flatten().dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    hashes = own[codes] if len(codes) else np.zeros(0, np.uint64)
    borders = split.offsets.to_numpy().astype(np.int64)
    keep = hashes != 0  # an empty text splits into one empty word
    if not keep.all():
        borders = np.concatenate([[0], np.cumsum(keep)])[borders - borders[0]]
        hashes = hashes[keep]
    return hashes, borders - borders[0]


def shingles(hashes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, times, borders): the distinct runs of SHINGLE words of each
    text, sorted, and how often they occur. A shorter text is one run."""
    n = len(hashes)
    runs = np.zeros(n, np.uint64)
    lens = np.diff(borders)
    left = np.repeat(borders[1:], lens) - np.arange(n)  # words to the text's end
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            there = np.zeros(n, np.uint64)
            there[: n - k] = hashes[k:] if k < n else 0
            if k:
                there[left <= k] = 0
            runs = (runs ^ there) * _MIX
            runs ^= runs >> np.uint64(29)
    whole = (left >= SHINGLE) | (np.repeat(lens, lens) < SHINGLE) & (left == np.repeat(lens, lens))
    of = np.repeat(np.arange(len(lens)), lens)[whole]
    runs = runs[whole]
    order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    return runs[at], np.diff(np.append(at, len(runs))), np.searchsorted(of[at], np.arange(len(lens) + 1))


@dataclass
class Weights:
    """The weight of a shingle: (1 + ln times) * idf. Plain idf would make
    copies in a group of thousands less alike than two copies of one text, as
    what they share becomes common while each copy's own words are rare. So idf
    is damped to 1 .. 1 + IDF_GAIN: the full gain for what the counters cannot
    tell from rare, none for what every document holds."""

    idf: np.ndarray

    def of(self, runs: np.ndarray, times: np.ndarray) -> np.ndarray:
        return ((1 + np.log(times)) * self.idf[(runs >> np.uint64(44)).astype(np.int64)]).astype(np.float32)


def document_frequencies(docs: DataFrame) -> Weights:
    """Counts, over all documents, in how many each shingle occurs. The
    counters are as many at every size, so their sum is what the driver gets
    (4 MB); shingles share them, and what a counter holds beyond its mean load
    (four deviations at least) is the estimate."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("near")
        sums, n = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for part in steps(batch, "text"):
                runs, _, _ = shingles(*word_hashes(part["text"]))
                sums += np.bincount((runs >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
                n += part.num_rows
        if n:
            task = TaskContext.get().partitionId()
            parts = [x.astype("<i8" if x.max() >= 1 << 31 else "<i4").tobytes() for x in sums.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "part": pa.array([task] * SLICES, pa.int32()), "n": pa.array([n] + [0] * (SLICES - 1), pa.int64()), "sums": pa.array(parts, pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // SLICES, np.int64)
        for raw in table["sums"]:
            raw = raw.as_py()
            total += np.frombuffer(raw, "<i4" if len(raw) == 4 * len(total) else "<i8")
        return pa.Table.from_pydict({"slice": table["slice"][:1].cast(pa.int32()), "part": table["part"][:1].cast(pa.int32()), "n": pa.array([pc.sum(table["n"]).as_py()], pa.int64()), "sums": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    kind = "slice int, part int, n long, sums binary"
    rows = bounded(docs).select("text").mapInArrow(count, kind)
    for _ in range(3):  # a tree: FAN parts of a slice at once, enough for FAN ** 3 tasks
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("slice", "part").applyInArrow(added, kind)
    rows = rows.toArrow()
    sums, n = np.zeros(COUNTERS), max(1, pc.sum(rows["n"]).as_py() or 0)
    for k, raw in zip(rows["slice"].to_pylist(), rows["sums"], strict=True):
        sums.reshape(SLICES, -1)[k] += np.frombuffer(raw.as_buffer(), "<i8")
    load = sums.mean()
    floor = max(2.0, 4 * load**0.5)
    df = np.clip(sums - load, floor, max(n, floor))
    rare = np.log(max(n, floor) / df) / max(1e-9, np.log(max(n, floor) / floor))
    return Weights((1 + IDF_GAIN * np.clip(rare, 0, 1)).astype(np.float32))


_sampling: dict[int, np.ndarray] = {}


def _table() -> np.ndarray:
    """ln a of improved consistent weighted sampling for every level of weight
    and entry, as unsigned integers in the same order: with r, c from
    Gamma(2, 1) and b uniform, t = floor(ln w / r + b), ln y = r (t - b),
    ln a = ln c - ln y - r. The sample is the shingle with the least a; its
    value tells the entry and t."""
    if not _sampling:
        g = np.random.default_rng(20240229)
        r, c, b = g.gamma(2, 1, ENTRIES), g.gamma(2, 1, ENTRIES), g.random(ENTRIES)
        out = np.empty((LEVELS, ENTRIES), np.uint32)
        for k in range(LEVELS):  # one level at a time, to bound memory
            t = np.floor(k / STEP / r + b)
            bits = (np.log(c) - r * (t - b) - r).astype(np.float32).view(np.uint32)
            out[k] = np.where(bits >> 31 == 1, ~bits, bits | np.uint32(1 << 31))
        _sampling[0] = out.reshape(-1)
    return _sampling[0]


def signatures(runs: np.ndarray, weights: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """One uint64 per text and sample. Texts without words get zeros."""
    table = _table()
    level = np.clip(np.rint(np.log(weights) * STEP), 0, LEVELS - 1).astype(np.uint64) * np.uint64(ENTRIES)
    low = runs & np.uint64(0xFFFFFFFF)
    out = np.zeros((len(borders) - 1, BANDS * ROWS), np.uint64)
    full = np.flatnonzero(np.diff(borders))
    odd = np.random.default_rng(7).integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = borders[:-1][full]
    cut = [0]  # pieces small enough for the processor's cache
    for i in range(1, len(full)):
        if borders[full[i]] - starts[cut[-1]] > 60_000:
            cut.append(i)
    with np.errstate(over="ignore"):
        for a, b in pairwise([*cut, len(full)]):
            if a == b:
                continue
            x, y = starts[a], borders[full[b - 1] + 1]
            own, lv, lo, at = runs[x:y], level[x:y], low[x:y], starts[a:b] - x
            for j in range(BANDS * ROWS):
                entry = ((own * odd[j]) >> np.uint64(48)) + lv
                out[full[a:b], j] = np.minimum.reduceat((table[entry].astype(np.uint64) << np.uint64(32)) | lo, at)
    return out


def sketches(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, h (hash of the text), key (16 bytes: the same words in the same
    order; texts without words by their text) and bands (a long each; null for
    texts without words)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("near")
        for batch in batches:
            for part in steps(batch, "text"):
                hashes, words = word_hashes(part["text"])
                runs, times, borders = shingles(hashes, words)
                sig = signatures(runs, sent.value.of(runs, times), borders)
                keys = [hashlib.md5(hashes[a:b].tobytes()).digest() if b > a else hashlib.md5(b"\0" + (t or "").encode()).digest() for (a, b), t in zip(pairwise(words), part["text"].to_pylist(), strict=True)]
                bands = []
                for row, full in zip(sig, np.diff(words) > 0, strict=True):
                    bands.append([int.from_bytes(xxhash.xxh3_64_digest(row[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k), "little", signed=True) for k in range(BANDS)] if full else None)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["h"], pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h", "key", "bands"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, key binary, bands array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over sum of the greater ones, of two sorted
    (shingle, weight) vectors; 0 if both are empty."""
    (x, v), (y, w) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    least = float(np.minimum(v[both], w[at[both]]).sum(dtype=np.float64))
    return least / (float(v.sum(dtype=np.float64)) + float(w.sum(dtype=np.float64)) - least)


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, least: float) -> DataFrame:
    """The pairs (a, b: keys) whose texts reach the similarity, as links.
    ``pairs`` is written; a hub ``b`` of many pairs is many tasks."""
    sent = pairs.sparkSession.sparkContext.broadcast(weights)

    def vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        runs, times, borders = shingles(*word_hashes(column))
        w = sent.value.of(runs, times)
        return [(runs[i:j], w[i:j]) for i, j in pairwise(borders)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("near")
        for batch in batches:
            for part in steps(batch, "text_a", 2_000_000):
                hubs = part["b"].dictionary_encode()
                first = np.unique(hubs.indices.to_numpy(), return_index=True)[1]
                hub = vectors(part["text_b"].take(pa.array(first)))
                keep = [weighted_jaccard(x, hub[k]) >= least for x, k in zip(vectors(part["text_a"]), hubs.indices.to_pylist(), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(texts.withColumnsRenamed({"key": "ka", "text": "text_a"}), F.col("a") == F.col("ka")).drop("ka")
    two = spread_join(one, texts.withColumnsRenamed({"key": "b", "text": "text_b"}), ["b"], ["a"], hot_keys(pairs, ["b"]))
    return bounded(two).select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def overlaps(left: list[tuple[np.ndarray, np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum of the lesser weights of every pair of (shingle, times, idf)
    vectors. A shingle that occurs t times is t features that weigh what each
    time adds, so the sum is one over common features: products of matrices for
    features of many, single pairs for the others."""

    def features(side):
        runs, times = np.concatenate([r for r, _, _ in side]), np.concatenate([t for _, t, _ in side])
        idf, of = np.concatenate([w for _, _, w in side]), np.repeat(np.arange(len(side)), [len(r) for r, _, _ in side])
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1
        with np.errstate(over="ignore"):
            name = (np.repeat(runs, times) ^ (nth.astype(np.uint64) * _MIX)) * _MIX
        gain = np.where(nth > 1, np.log(nth / np.maximum(nth - 1, 1)), 1.0)
        return name, np.repeat(of, times), np.repeat(idf, times) * gain

    (a, of_a, w), (b, of_b, _) = features(left), features(right)
    names, at = np.unique(a, return_inverse=True)
    place = np.minimum(np.searchsorted(names, b), max(0, len(names) - 1))
    there = names[place] == b if len(names) else np.zeros(len(b), bool)
    place, of_b = place[there], of_b[there]
    by_a, by_b = np.argsort(at, kind="stable"), np.argsort(place, kind="stable")
    n_a, n_b = np.bincount(at, minlength=len(names)), np.bincount(place, minlength=len(names))
    from_a, from_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    out = np.zeros(len(left) * len(right))
    many = n_a * n_b > 256
    few = np.flatnonzero(~many & (n_b > 0))
    # every pair of each feature of few: places of a repeated, those of b in turn
    for part in np.array_split(few, max(1, int((n_a[few] * n_b[few]).sum()) // PAIRS)):
        n = n_a[part] * n_b[part]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(n_b[part], n)
        x = by_a[np.repeat(from_a[part], n) + k // wide] if len(k) else np.zeros(0, int)
        y = by_b[np.repeat(from_b[part], n) + k % wide] if len(k) else np.zeros(0, int)
        out += np.bincount(of_a[x] * len(right) + of_b[y], w[x], len(out))
    out = out.reshape(len(left), len(right))
    rank = np.cumsum(many) - 1
    step = max(1, 4_000_000 // max(len(left), len(right)))
    x, y = np.flatnonzero(many[at]), np.flatnonzero(many[place])
    for low in range(0, int(many.sum()), step):
        i, j = x[(rank[at[x]] >= low) & (rank[at[x]] < low + step)], y[(rank[place[y]] >= low) & (rank[place[y]] < low + step)]
        one, two = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        one[of_a[i], rank[at[i]] - low] = w[i]
        two[of_b[j], rank[place[j]] - low] = 1
        out += one @ two.T
    return out


def alike(left: pa.Array, right: pa.Array | None, weights: Weights, least: float) -> np.ndarray:
    """Which texts of two columns (or of one, beside themselves) reach the
    similarity, as a matrix."""

    def vectors(column: pa.Array):
        runs, times, borders = shingles(*word_hashes(column))
        idf = weights.idf[(runs >> np.uint64(44)).astype(np.int64)]
        w = weights.of(runs, times)
        return [(runs[i:j], times[i:j], idf[i:j]) for i, j in pairwise(borders)], [(runs[i:j], w[i:j]) for i, j in pairwise(borders)]

    one, plain = vectors(left)
    two, other = (one, plain) if right is None else vectors(right)
    common = overlaps(one, two)
    whole = np.array([w.sum(dtype=np.float64) for _, w in plain])[:, None] + np.array([w.sum(dtype=np.float64) for _, w in other])[None]
    share = common / np.maximum(whole - common, 1e-9)
    out = share >= least
    for i, j in np.argwhere(np.abs(share - least) < MARGIN):
        out[i, j] = weighted_jaccard(plain[i], other[j]) >= least
    if right is None:
        np.fill_diagonal(out, False)
    return out


def stars(found: np.ndarray, left: list, right: list) -> list[tuple]:
    """Links from one node of each component of a matrix to its others."""
    out = []
    rows, cols = found.any(1), found.any(0)
    for i in np.flatnonzero(rows):
        front = np.array([i]) if rows[i] else np.zeros(0, int)
        while len(front):
            rows[front] = False
            to = np.flatnonzero(found[front].any(0) & cols)
            cols[to] = False
            out += [(left[i], left[k]) for k in front if k != i] + [(left[i], right[k]) for k in to]
            front = np.flatnonzero(found[:, to].any(1) & rows)
    return out


def compared(buckets: DataFrame, texts: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Links (a, b) that join what every pair of nodes of different parts
    joins in buckets (v, key, part) of any size. The nodes outside of a
    bucket's largest part are dealt to blocks, which meet each other and the
    blocks of the largest part; a task holds two blocks."""
    sent = buckets.sparkSession.sparkContext.broadcast(weights)
    sized = buckets.join(texts.select("key", F.length("text").cast("long").alias("chars")), "key")
    each = sized.groupBy("v", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    all_ = each.groupBy("v").agg(F.max(F.struct("n", "part", "chars")).alias("top"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    number = lambda n, chars: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(chars / BLOCK_CHARS)).cast("int")
    plan = all_.select("v", F.col("top.part").alias("main"), number(F.col("top.n"), F.col("top.chars")).alias("mains"), number(F.col("n") - F.col("top.n"), F.col("chars") - F.col("top.chars")).alias("rests"))
    dealt = spread_join(buckets, plan, ["v"], ["key"]).withColumn("is_main", F.col("part") == F.col("main"))
    dealt = dealt.withColumn("k", F.pmod(_hash("key", "v"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    place = lambda main, i, j, first: F.struct(F.lit(main).alias("main"), i.alias("i"), j.alias("j"), F.lit(first).alias("first"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    k = F.col("k")
    of_main = F.transform(upto(F.col("rests")), lambda i: place(True, i, k, False))
    earlier = F.transform(F.sequence(F.lit(0), k), lambda j: place(False, k, j, True))
    later = F.transform(F.filter(upto(F.col("rests")), lambda i: i > k), lambda i: place(False, i, k, False))
    of_rest = F.concat(F.transform(upto(F.col("mains")), lambda j: place(True, k, j, True)), earlier, later)
    placed = dealt.select("v", "key", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_rest)).alias("at")).select("v", "key", "at.*")

    def run(table: pa.Table) -> pa.Table:
        working("near")
        first = table["first"].combine_chunks()
        one, two = table.filter(first), table.filter(pc.invert(first))
        links = []
        if one.num_rows and (two.num_rows or not table["main"][0].as_py() and table["i"][0] == table["j"][0]):
            right = two if two.num_rows else one
            found = alike(one["text"].combine_chunks(), two["text"].combine_chunks() if two.num_rows else None, sent.value, least)
            links = stars(found, one["key"].to_pylist(), right["key"].to_pylist())
        return pa.Table.from_pydict({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return bounded(placed.join(texts, "key")).groupBy("v", "main", "i", "j").applyInArrow(run, "a binary, b binary")


def _hash(*cols) -> Column:
    return F.xxhash64(*cols)


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, h, key and class_id of every row: rows linked by chains of
    similarity ``least`` or more share the least doc_id among them.

    Texts of the same words are one node from the start, whatever their
    number. Nodes meet in band buckets. First each meets its bucket's leader,
    the node in the most company (in a large group of edited copies, the one
    nearest their origin); then nodes of still different components meet each
    other where they share a bucket of up to SMALL nodes, or, in larger ones,
    a sub-bucket of two bands: each other if it is that small, else its leader.
    What is then still apart in a large bucket is compared in blocks with all
    nodes of other components there, so every pair that a band brings together
    is verified or already linked. Joined rows grow with the documents; only
    the comparisons inside of blocks grow with the square of a group that stays
    apart.

    Null texts are empty texts; texts without words are alike only if equal.
    Texts of fewer than five words are one shingle. Null doc_ids take part and
    yield to others as class_id. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    weights = document_frequencies(docs)
    sig = materialise(sketches(docs, weights), "sketches")
    nodes = materialise(sig.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("at"), F.first("bands").alias("bands")), "nodes")
    inside = materialise(nodes.filter("bands is not null").select("key", F.explode("bands").alias("v")), "bands")
    sizes = materialise(inside.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    hot = materialise(hot_keys(inside, ["v"], sizes), "hot-buckets")
    members = materialise(spread_join(inside, sizes, ["v"], ["key"], hot).select("key", "v", "n"), "members")
    company = members.groupBy("key").agg(F.sum("n").alias("company"))
    leaders = members.join(company, "key").groupBy("v").agg(F.max(F.struct("company", "key"))["key"].alias("b"))
    pairs = materialise(spread_join(members, leaders, ["v"], ["key"], hot).filter("key != b").select(F.col("key").alias("a"), "b").distinct(), "pairs")

    near = members.select("key").distinct().join(nodes, "key").select("key", F.col("at.doc_id").alias("d"), F.col("at.h").alias("th"))
    located = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    texts = located.join(near, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))).select("key", "text")
    texts = materialise(texts.dropDuplicates(["key"]), "texts")  # rows may repeat
    links = materialise(verified(pairs, texts, weights, least), "links")
    parts = components(links)

    placed = materialise(members.join(parts, F.col("key") == F.col("node"), "left").select("v", "n", "key", F.coalesce("label", "key").alias("part")), "placed")
    mixed = placed.groupBy("v").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).filter("p0 != p1").select("v")
    open_ = materialise(spread_join(placed, mixed, ["v"], ["key"], hot), "open")
    few = open_.filter(F.col("n") <= SMALL).select("v", "key", "part")
    big = open_.filter(F.col("n") > SMALL)
    twice = big.groupBy("key", "part").agg(F.sort_array(F.collect_set("v")).alias("vs")).select("key", "part", F.explode("vs").alias("v1"), "vs").select("key", "part", "v1", F.explode("vs").alias("v2")).filter("v1 < v2").select(_hash("v1", "v2").alias("v"), "key", "part")
    twice = materialise(twice, "sub-buckets")
    sub = twice.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("p0"), F.max("part").alias("p1"), F.min(F.struct(_hash("key", "v").alias("x"), "key", "part")).alias("lead")).filter("n > 1 and p0 != p1")
    met = materialise(spread_join(twice, sub, ["v"], ["key"]), "met")
    by_leader = met.filter((F.col("n") > SMALL) & (F.col("part") != F.col("lead.part"))).select(F.col("key").alias("a"), F.col("lead.key").alias("b"))
    few = few.unionByName(met.filter(F.col("n") <= SMALL).select("v", "key", "part"))
    # few has at most SMALL rows of a v
    other = few.select("v", F.col("key").alias("b"), F.col("part").alias("other"))
    within = few.join(other, "v").filter((F.col("key") < F.col("b")) & (F.col("part") != F.col("other"))).select(F.col("key").alias("a"), "b")
    more = by_leader.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialise(more.join(tried, ["a", "b"], "left_anti"), "pairs")
    found = materialise(verified(more, texts, weights, least), "links")
    if not found.isEmpty():
        links = links.union(found)
        parts = components(links)
    apart = materialise(big.select("v", "key").join(parts, F.col("key") == F.col("node"), "left").select("v", "key", F.coalesce("label", "key").alias("part")), "parts")
    mixed = apart.groupBy("v").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).filter("p0 != p1").select("v")
    apart = materialise(spread_join(apart, mixed, ["v"], ["key"], hot), "apart")
    if not apart.isEmpty():
        found = materialise(compared(apart, texts, weights, least), "links")
        if not found.isEmpty():
            parts = components(links.union(found))
    named = nodes.select("key", "at").join(parts, F.col("key") == F.col("node"), "left").select("key", "at", F.coalesce("label", "key").alias("part"))
    least_id = named.groupBy("part").agg(F.min("at").alias("first"))
    named = named.join(least_id, "part").select("key", F.col("first.doc_id").alias("class_id"))
    return spread_join(sig.select("doc_id", "h", "key"), named, ["key"], ["doc_id", "h"])


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id and class_id (least doc_id of the class) of every row."""
    return classes(docs, least).select("doc_id", "class_id")


def deduplicated(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row of each class, with the columns of ``docs``: the one with the
    least doc_id, then the least text hash; of rows that agree in both, any."""
    best = classes(docs, least).groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("key")).alias("k")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("at"))
    d, h, t = free(docs, "__d"), free(docs, "__h"), free(docs, "__t")
    best = materialise(best.select(F.col("at.doc_id").alias(d), F.col("at.h").alias(h)), "kept").distinct()
    keyed = docs.withColumn(t, F.xxhash64(F.coalesce("text", F.lit(""))))
    met = keyed.join(best, keyed["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.col(t) == F.col(h)))
    if docs.select("doc_id", "text").groupBy("doc_id", F.xxhash64("text").alias("h")).count().filter("count > 1").isEmpty():
        return met.select(*docs.columns)
    return met.dropDuplicates([d, h]).select(*docs.columns)
