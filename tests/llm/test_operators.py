from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import parity
import pyarrow as pa
import pytest
from edges import BASE, empty, frame, rows
from pyspark.sql import functions as F

from finweave.llm import ann, chat, graph, media, mixing, near, packing, pii, queries, secrets, shared, tokens, toxicity

WORD = queries.WORD_BPE


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


# 1 mixing ------------------------------------------------------------------


def water(sizes, weights, most):
    """Excess over the cap reshared by weight until none is above: step by step."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        share = {i: (most * sizes[i] if i in capped else rest * weights[i] / w) for i in range(len(sizes))}
        over = {i for i in share if i not in capped and share[i] > most * sizes[i] + 1e-9}
        if not over:
            return share
        capped |= over


@pytest.mark.parametrize("sizes", [[10, 500, 40, 700], [1, 1, 1], [0, 5, 100], [3, 3000], [0, 0]])
def test_targets_match_resharing(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, (5, 2, 1), 3.0).collect()}
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    if sum(sizes):
        want = water(sizes, w, 3.0)
        assert all(math.isclose(got[f"s{i}"], want[i], abs_tol=1e-6) for i in range(len(sizes)))
    else:
        assert set(got.values()) <= {0.0, None}


def test_mix_edges(spark):
    d = frame(spark)
    p = mixing.plan(d).collect()
    assert len(p) == len(rows())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in p)
    assert {r["size"] for r in p if r["doc_id"] in (3, 4, 5)} == {0}
    assert sorted(map(str, p)) == sorted(map(str, mixing.plan(d).collect()))
    m = mixing.mix(d)
    assert m.columns == d.columns
    words = m.agg(F.sum(mixing.words(F.col("text")))).collect()[0][0]
    assert words == sum(r["taken"] for r in p)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.plan(empty(spark)).count() == 0


def test_mix_is_near_its_targets(spark):
    g = random.Random(3)
    d = spark.createDataFrame([(i, "w " * g.randint(1, 60), g.choice("abcd")) for i in range(3000)], "doc_id long, text string, source string")
    for r in mixing.plan(d).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r["t"] / r["g"] - 1) < 0.01


# 2 media -------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 161, 162, 163, 345, 576, 9216, 9217, 30_000])
def test_streams_round_trip(n):
    data = random.Random(n).randbytes(n)
    s = media.mux(data)
    back = media.demux(s)
    assert len(s) % 188 == 0 and all(s[i] == 0x47 for i in range(0, len(s), 188))
    assert back["payload"] == data and back["continuity_errors"] == 0 and back["broken"] == 0
    assert [b for _, b, _ in back["access"]] == list(range(0, n, media.UNIT))


def test_damaged_streams_are_counted():
    s = media.mux(bytes(range(256)) * 100)
    lost = media.demux(s[: 188 * 5] + s[188 * 6 :])
    assert lost["continuity_errors"] == 1 and lost["broken"] >= 1
    torn = bytearray(s)
    torn[188 * 4] = 0
    assert media.demux(bytes(torn))["broken"] >= 1
    assert media.demux(b"")["packets"] == 0 and media.demux(None) is None
    assert media.demux(b"\x00" * 188)["payload"] == b""


def _packets(stream):
    return [stream[i : i + 188] for i in range(0, len(stream), 188)]


def test_streams_of_others():
    data = bytes(range(256)) * 100
    s = media.mux(data)
    p = _packets(s)
    good = media.demux(s)
    twice = media.demux(b"".join([*p[:6], p[5], *p[6:]]))
    assert twice["payload"] == data and twice["continuity_errors"] == 0 and twice["packets"] == len(p) + 1
    # a packet without payload has the counter of the one before
    bare = bytearray(b"\xff" * 188)
    bare[:6] = bytes([0x47, p[5][1] & 0x1F, p[5][2], 0x20 | p[5][3] & 15, 183, 0])
    silent = media.demux(b"".join([*p[:6], bytes(bare), *p[6:]]))
    assert silent["payload"] == data and silent["continuity_errors"] == 0
    bad = bytearray(p[5])
    bad[1] |= 0x80
    torn = media.demux(b"".join([*p[:5], bytes(bad), *p[6:]]))
    assert torn["broken"] == 2 and torn["continuity_errors"] == 1 and len(torn["payload"]) == len(data) - media.UNIT
    # an announced jump of the counter
    k = next(i for i in range(3, len(p)) if p[i][1] & 0x40 and i > 10)
    jump = [bytearray(x) for x in p]
    for i in range(k, len(jump)):
        jump[i][3] = jump[i][3] & 0xF0 | (jump[i][3] + 5) & 15
    assert media.demux(b"".join(map(bytes, jump)))["continuity_errors"] == 1
    jump[k][5] |= 0x80
    told = media.demux(b"".join(map(bytes, jump)))
    assert told["continuity_errors"] == 0 and told["payload"] == data and told["access"] == good["access"]


def test_program_tables_over_packets():
    import struct

    p = _packets(media.mux(b"x" * 576))
    info = bytes([0x05, 200]) + b"i" * 200  # a descriptor that does not fit into one packet
    body = struct.pack(">HH", 0xE000 | media.ES_PID, 0xF000 | len(info)) + info + struct.pack(">BHH", media.STREAM_TYPE, 0xE000 | media.ES_PID, 0xF000)
    raw = b"\0" + media._section(2, media.PROGRAM, body)
    head = lambda start, n: struct.pack(">BHB", 0x47, (0x4000 if start else 0) | media.PMT_PID, 0x10 | n)
    one, two = head(True, 0) + raw[:184], (head(False, 1) + raw[184:]).ljust(188, b"\xff")
    got = media.demux(b"".join([p[0], one, two, *p[2:]]))
    assert got["payload"] == b"x" * 576 and got["stream_type"] == media.STREAM_TYPE
    assert media.demux(b"".join([p[0], one, *p[2:]]))["es_pid"] == -1
    rest = head(True, 1) + bytes([len(raw) - 184]) + raw[184:]  # ends one section where a pointer says
    assert media.demux(b"".join([p[0], one, rest.ljust(188, b"\xff"), *p[2:]]))["payload"] == b"x" * 576


def test_media_columns(spark):
    d = frame(spark).withColumn("payload", media.padded(F.col("text")))
    out = media.decode(media.encode(d))
    for r in out.collect():
        raw = (r["text"] or "").encode()
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert bytes(r["stream"]["payload"]) == want and r["h"] == "extra"
    assert media.decode(media.encode(empty(spark).withColumn("payload", media.padded(F.col("text"))))).count() == 0


# 3 near duplicates -----------------------------------------------------------


def brute_classes(texts, weights):
    vec = []
    for t in texts:
        runs, times, _ = near.shingles(*near.word_hashes(pa.array([t])))
        vec.append((runs, weights.of(runs, times)))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] == texts[j] or near.weighted_jaccard(vec[i], vec[j]) >= 0.8:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_classes_match_brute_force(spark):
    g = random.Random(5)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(g.randint(6, 80))) for _ in range(60)]
    for k in range(140):  # chains of edits of earlier texts, and copies
        t = g.choice(texts).split()
        for _ in range(g.randint(0, 4)):
            t[g.randrange(len(t))] = word()
        texts.append(" ".join(t))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = near.document_frequencies(d)
    got = dict(near.near_duplicates(d).collect())
    assert [got[i] for i in range(len(texts))] == brute_classes(texts, weights)


def test_large_group_of_copies_is_one_class(spark):
    g = random.Random(9)
    base = [f"w{g.randrange(900)}" for _ in range(150)]
    docs = []
    for i in range(400):
        t = list(base)
        for _ in range(g.randint(0, 2)):
            t[g.randrange(150)] = f"x{g.randrange(9999)}"
        docs.append((i, " ".join(t)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {c for _, c in near.near_duplicates(d).collect()} == {0}
    assert near.deduplicated(d).count() == 1


@pytest.mark.parametrize("block", [near.BLOCK, 100])
def test_pairs_in_a_group_of_one_boilerplate(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    g = random.Random(21)
    base = [f"w{g.randrange(900)}" for _ in range(160)]
    texts = []
    for i in range(450):  # about 0.67 alike to all others; each has a near copy
        own = [f"x{g.randrange(10**9)}" for _ in range(34)]
        texts.append(" ".join(base + own))
        texts.append(" ".join(base + own[:20] + [f"y{g.randrange(10**9)}" for _ in range(14)]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = near.document_frequencies(d)
    want = brute_classes(texts, weights)
    assert len(set(want)) == 450
    got = dict(near.near_duplicates(d).collect())
    assert [got[i] for i in range(len(texts))] == want


def plain_similarity(a: str, b: str, gain: float) -> float:
    """Jaccard of five-word shingles weighted 1 + ln times, those of one text alone (or, if it is negative, common ones) heavier by ``gain``."""

    def vector(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return {s: 1 + math.log(k) for s, k in Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))).items()}

    x, y = vector(a), vector(b)
    common = {s: min(v, y[s]) for s, v in x.items() if s in y}
    rest = sum(x.values()) + sum(y.values()) - 2 * sum(common.values())
    least = sum(common.values()) * (1 + max(0, -gain))
    return least / (least + rest * (1 + max(0, gain)))


def test_classes_match_an_independent_version(spark):
    """Nothing of the operator is used; its idf lies within 1 .. 1.25, and no
    pair of these texts is so near to 0.8 that it could decide."""
    g = random.Random(31)
    word = lambda: "".join(g.choice("bdfgklmnprst") + g.choice("aeiou") for _ in range(3))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(g.randint(170, 260))]
        texts.append(" ".join(base))
        for _ in range(g.randint(0, 4)):
            t = list(base)
            t[g.randrange(len(t))] = word()
            texts.append(" ".join(t))
        for k in range(0, len(base), 7):
            base[k] = word()
        texts.append(" ".join(base))
    texts += [texts[0].upper(), texts[3] + "!", "", " ", "one two"]
    want = list(range(len(texts)))

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i].strip() and texts[j].strip():
            low, high = (plain_similarity(texts[i], texts[j], gain) for gain in (0.25, -0.25))
            assert low > 0.8 or high < 0.8
            if low > 0.8:
                want[max(find(i), find(j))] = min(find(i), find(j))
    g.shuffle(order := list(range(len(texts))))
    d = spark.createDataFrame([(i, texts[i], "x", 1) for i in order], "doc_id long, text string, __h string, __t int")
    got = dict(near.near_duplicates(d).collect())
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    kept = near.deduplicated(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {find(i) for i in range(len(texts))}


def test_pairs_of_repeated_rows(spark):
    """Rows that repeat a thousand times are compared once."""
    a = " ".join(f"w{i}" for i in range(200))
    d = spark.createDataFrame([(1, a)] * 1500 + [(2, a.replace("w7 ", "x "))] * 1500 + [(None, None)] * 1500, "doc_id long, text string")
    got = Counter(tuple(r) for r in near.near_duplicates(d).collect())
    assert got == {(1, 1): 1500, (2, 1): 1500, (None, None): 1500}
    assert near.deduplicated(d).count() == 2


def test_hot_keys_are_bounded(spark):
    d = spark.range(40_000).select(F.when(F.col("id") < 30_000, F.lit(None)).otherwise(F.col("id") % 1000).alias("k"), "id")
    few = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    assert shared.hot_keys(d, ["k"]).count() == 1
    got = shared.spread_join(d, few, ["k"])
    assert got.columns == ["k", "id", "v"]
    assert got.count() == 30_000 + d.filter("k > 0").count() and got.filter("v != coalesce(k, 0) * 2").count() == 0


def test_overlaps_match_single_pairs():
    g = random.Random(2)
    texts = [" ".join(g.choice("ab") for _ in range(g.randint(0, 90))) for _ in range(40)] + ["", "a b c d e " * 30]
    weights = near.Weights(np.random.default_rng(3).uniform(1, 1.25, near.COUNTERS).astype(np.float32))
    vec = [near.shingles(*near.word_hashes(pa.array([t])))[:2] for t in texts]
    pairs = [(r, weights.of(r, t)) for r, t in vec]
    for least in (0.2, 0.5, 0.8):
        want = [[i != j and near.weighted_jaccard(a, b) >= least for j, b in enumerate(pairs)] for i, a in enumerate(pairs)]
        assert near.alike(pa.array(texts), None, weights, least).tolist() == want
        assert near.alike(pa.array(texts[:7]), pa.array(texts[7:]), weights, least).tolist() == [row[7:] for row in want[:7]]


def test_near_edges(spark):
    got = near.classes(frame(spark)).collect()
    assert len(got) == len(rows())
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["class_id"])
    assert by[0] == by[1] == {0}
    assert by[3] == by[4] == {3}  # null and empty texts are equal
    assert by[5] == {5} and by[None] == {None}
    kept = near.deduplicated(frame(spark))
    assert kept.columns == frame(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect())[1] == 0
    assert near.near_duplicates(empty(spark)).count() == 0 and near.deduplicated(empty(spark)).count() == 0


def test_sampling_meets_as_often_as_alike():
    g = np.random.default_rng(1)
    runs = np.sort(g.integers(1 << 62, size=400).astype(np.uint64))
    a, b = runs[:300], np.sort(runs[100:])
    wa, wb = np.full(300, 1.2, np.float32), np.full(300, 1.2, np.float32)
    sa = near.signatures(a, wa, np.array([0, 300]))[0]
    sb = near.signatures(b, wb, np.array([0, 300]))[0]
    assert abs((sa == sb).mean() - near.weighted_jaccard((a, wa), (b, wb))) < 0.2
    assert near.weighted_jaccard((a, wa), (a, wa)) == 1


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(graph.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and got[103] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4 packing and 8 token files --------------------------------------------------


def test_coder_equals_the_library(plain):
    texts = [r[1] or "" for r in rows()] + ["It's a TEST's end.A b.c , d...", "x  y\n\nz.", "Ünïcode ﬀ ① Ⅷ it'll", ".,.", "Å B", "İI ı K ſ"]
    c = tokens.Coder(WORD)
    ids, borders = c.encode(pa.array([t for t in texts if "<|" not in t]))
    want = [e.ids for e in plain.encode_batch([t for t in texts if "<|" not in t], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(borders)] == want
    ids, _ = c.encode(pa.array(["a <|endoftext|> b"]))
    assert ids.tolist() == plain.encode("a <|endoftext|> b", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << min(bits, 31), 999).astype("<u4")
    raw = tokens.pack_bits(ids, bits)
    assert len(raw) == -(-999 * bits // 8) and (tokens.unpack_bits(raw, 999, bits) == ids).all()


def test_token_files_have_random_access(tmp_path):
    import pyarrow.fs as pafs

    docs = [(None, 3), (1, 0), (2, 5000), (3, 1), (4, 12_345)]
    g = np.random.default_rng(0)
    data = [g.integers(0, 1 << 13, n).astype("<u4") for _, n in docs]
    fs = pafs.LocalFileSystem()
    path = str(tmp_path / "x.ids")
    with fs.open_output_stream(path) as sink:
        w = tokens.TokenFileWriter(sink, 13, 129)
        for (d, _), x in zip(docs, data, strict=True):
            w.add(d, x)
        w.close()
    with fs.open_input_file(path) as source:
        f = tokens.TokenFile(source)
        assert f.docs == [d for d, _ in docs]
        assert all((f.doc(k) == x).all() for k, x in enumerate(data))
        whole = np.concatenate(data)
        assert (f.ids(777, 9001) == whole[777:9001]).all()


def test_token_files_edges(spark, plain):
    d = frame(spark)
    got = tokens.read_token_files(tokens.write_token_files(d, WORD, 2)).orderBy("start").collect()
    want = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in want]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    texts = {r[0]: r[1] for r in rows()}
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
    assert tokens.read_token_files(tokens.write_token_files(empty(spark), WORD, 2)).count() == 0


def test_packing_edges(spark, plain):
    d = frame(spark)
    got = packing.pack_documents(d, WORD).collect()
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    want = Counter()
    for doc_id, text, *_ in rows():
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            x = ids[k : k + 2048]
            want[doc_id, k // 2048, k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    assert pieces == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for seq in by.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(empty(spark), WORD).count() == 0
    clash = spark.createDataFrame([(1, 0, 7, "x"), (2, 0, 7, "y")], "doc_id long, piece int, length long, first string")
    assert packing.pack(clash, 16).count() == 2
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 17)], "doc_id long, piece int, length long"), 16)


def best_fit_decreasing(lengths, capacity):
    """Number of sequences of sequential best fit, longest first."""
    from bisect import bisect_left, insort

    gaps: list[int] = []
    for x in sorted(lengths, reverse=True):
        k = bisect_left(gaps, x)
        insort(gaps, (gaps.pop(k) if k < len(gaps) else capacity) - x)
    return len(gaps)


@pytest.mark.parametrize(
    "lengths",
    [
        [random.Random(3).randint(1, 64) for _ in range(500)],
        [min(64, 1 + int(random.Random(k).expovariate(1 / 9))) for k in range(700)],
        [22] * 300 + [40] * 50 + [3] * 200,
        [1] * 200,
        [64] * 5 + [33] * 9,
    ],
    ids=["even", "short", "hot", "ones", "long"],
)
def test_supersteps_pack_as_tight_as_sequential_best_fit(spark, lengths):
    d = spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length int, rank string")
    by = defaultdict(list)
    for r in packing.pack(d, 64).collect():
        assert r["length"] == lengths[r["doc_id"]] and r["rank"] == "x"
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(map(len, by.values())) == len(lengths)
    for seq in by.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= 1.01 * best_fit_decreasing(lengths, 64) + 1


def test_pieces_meet_their_successors():
    """One superstep's slots and pieces against a sweep with a real stack."""
    g = random.Random(5)
    for _ in range(200):
        gaps, left = np.zeros(31, np.int64), np.zeros(31, np.int64)
        for _ in range(g.randint(1, 12)):
            gaps[g.randint(1, 30)] += g.randint(1, 3)
            left[g.randint(1, 30)] += g.randint(1, 3)
        longest = int(np.flatnonzero(left)[-1])
        slots, pops = packing.depths(gaps, left)
        own = {}
        for gap, base, each, floor in slots:
            for k in range(int(gaps[gap]) * each):
                if base + k >= floor:
                    own.setdefault(base + k, []).append((-min(gap, longest), 0, gap))
        for size, top, n in pops:
            for k in range(n):
                own.setdefault(top - 1 - k, []).append((-size, 1, size))
        got = Counter()
        for turns in own.values():
            turns.sort()
            for one, two in itertools.pairwise(turns):
                if two[1]:
                    assert not one[1]
                    got[two[2], one[2]] += 1
        stack, want = [], Counter()
        for size in range(longest, 0, -1):
            for gap in range(30, size - 1, -1) if size == longest else (size,):
                stack += [gap] * int(gaps[gap]) * max(1, gap // longest)
            for _ in range(int(left[size])):
                if stack:
                    want[size, stack.pop()] += 1
        assert got == want


# 5 nearest neighbours -----------------------------------------------------------


def test_neighbours(spark):
    g = np.random.default_rng(2)
    x = np.concatenate([g.normal(size=(400, 16)), g.normal(size=16) + 0.05 * g.normal(size=(200, 16))])
    x[5] = x[6]
    data = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    data += [(1000, None, "n"), (1050, [0.0] * 16, "z"), (1100, [float("nan")] * 16, "q"), (1150, [None] * 16, "w"), (1200, [float("inf")] * 16, "i"), (1250, [], "e"), (1300, [1.0, 2.0], "other")]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string")
    got = ann.search(d, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, rs in itertools.groupby(got, key=lambda r: r["query_id"]):
        rs = list(rs)
        if q >= 600:
            raise AssertionError(q)
        s = u @ u[q]
        s[q] = -9
        assert [r["rank"] for r in rs] == [1, 2, 3, 4, 5]
        assert all(abs(s[r["vec_id"]] - r["score"]) < 1e-12 for r in rs)
        hits += len(set(np.argsort(-s)[:5]) & {r["vec_id"] for r in rs})
    assert hits >= 0.9 * 60


def test_few_vectors_find_all(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (50, [-1.0, 0.1]), (7, [0.0, 1.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(d, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 50), (0, 7), (50, 0), (50, 7)}
    assert ann.search(d.limit(0), F.lit(True)).count() == 0


def test_probes_are_distinct_neighbours():
    g = np.random.default_rng(3)
    for m in (4, 6, 8, 12):
        at = g.normal(size=m) * 3
        steps = ann.probes(at, 300)
        assert not steps[0].any() and np.abs(steps).max() == 1
        assert len({tuple(x) for x in steps}) == len(steps) == min(300, 3**m)
        low = at - np.floor(at)
        cost = (np.where(steps == -1, low, 0) ** 2 + np.where(steps == 1, 1 - low, 0) ** 2).sum(1)
        early, late = cost[: len(cost) // 4].mean(), cost[-len(cost) // 4 :].mean()
        assert early < late
    assert len({tuple(x) for x in ann.probes(np.array([0.5, 1.5, 2.5, 3.5]), 81)}) == 81


def test_a_vector_that_most_rows_have(spark, monkeypatch):
    """Equal vectors among rows and queries, grids of tasks, ties by id."""
    monkeypatch.setattr(ann, "LOAD", 64)
    monkeypatch.setattr(ann, "QUERIES", 2)
    monkeypatch.setattr(shared, "HOT_ROWS", 8)
    g = np.random.default_rng(6)
    x = g.normal(size=(900, 12)).astype(np.float32)
    x[np.arange(900) % 3 == 0] = x[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[0].tolist())] * 200
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(d, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 50))
    x = x.astype(float)
    hits = 0
    for q, mine in got.items():
        want = sorted((-ann.cosine(x[q], x[i]), i) for i in range(900) if i != q)[:5]
        assert all(math.isclose(s, ann.cosine(x[q], x[i]), abs_tol=1e-15) for i, s in mine) and len(mine) == 5
        assert mine == sorted(mine, key=lambda r: (-r[1], r[0]))
        hits += len({i for i, _ in mine} & {i for _, i in want})
        if q % 3 == 0:
            assert [i for i, _ in mine] == [i for _, i in want]
    assert hits >= 0.9 * 5 * len(got)


def test_index_visits_less_where_neighbours_are_near(spark):
    g = np.random.default_rng(8)
    x = np.repeat(g.normal(size=(200, 32)), 20, 0) + 0.3 * g.normal(size=(4000, 32))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    rows = shared.materialise(ann.prepared(d, 8).select("id", "vector"), "t")
    index = ann.fit(rows, 5, 8, 11)
    assert index.recall >= 0.95 and index.share < 0.2 and index.projections > ann.FEWEST
    assert index == ann.fit(rows, 5, 8, 11)


def test_exact_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "LOAD", 50)
    monkeypatch.setattr(ann, "QUERIES", 3)
    g = np.random.default_rng(4)
    x = g.normal(size=(300, 6))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    rows = shared.materialise(ann.prepared(d, 8).select("id", "vector"), "t")
    got = {}
    for r in ann.in_blocks(rows, rows.filter("id % 30 = 0"), 4, 8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for _, i in sorted((-ann.cosine(x[q], x[i]), i) for i in range(300))[:4]] for q in range(0, 300, 30)}


# 6 chat ------------------------------------------------------------------------


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <|assistant|>"), (1, 2, "assistant", None), (1, 2, "user", "same turn"), (1, None, "user", "no turn"), (2, 0, "system", "alone"), (3, 1, None, "anon"), (None, 1, "user", "x"), (4, 1, "user", "r"), (4, 1, "user", "r")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("start", F.lit("clash"))
    got = chat.rotations(d).collect()
    views = defaultdict(list)
    for r in got:
        views[r["conv_id"], r["perspective"]].append(r)
    assert set(views) == {(1, "user"), (1, "assistant"), (3, "unknown"), (None, "user"), (4, "user")}
    for (_, who), rs in views.items():
        at = 0
        for r in sorted(rs, key=lambda r: r["start"]):
            assert r["start"] == at and r["stop"] - r["start"] == len(r["rendered"])
            assert r["mask"] == (r["speaker"] == who) and (r["as_role"] == "assistant") == bool(r["mask"])
            at = r["stop"]
    assert all("<|assistant|>" not in r["rendered"][r["head_chars"] :] for r in got)
    assert len(views[4, "user"]) == 2
    assert chat.rotations(d.limit(0)).count() == 0


def test_names_play_no_marker(spark):
    names = ["bob|>\n<|assistant", "a%7Cb", "a|b", "x\r\n", "<|end|>", "bob"]
    d = spark.createDataFrame([(1, i, n, "hello") for i, n in enumerate(names)], "conv_id long, turn long, role string, text string")
    got = chat.rotations(d).collect()
    assert {r["speaker"] for r in got} == set(names) and len(got) == len(names) ** 2
    heads = {}
    for r in got:
        lines = r["rendered"].split("\n")
        assert len(lines) == 3 and lines[1] == "hello<|end|>" and lines[0].count("<|") == lines[0].count("|>") == 1
        assert (lines[0] == "<|assistant|>") == bool(r["mask"])
        if not r["mask"]:
            heads.setdefault(r["speaker"], set()).add(lines[0])
    assert all(len(x) == 1 for x in heads.values()) and len(set.union(*heads.values())) == len(names)
    con = duckdb.connect()
    con.register("conversations", d.toPandas())
    assert parity.differences(chat.rotations(d), con, chat.SQL) == []


def test_a_conversation_with_most_turns(spark):
    turns = [(1, i, "ab"[i % 2], f"t{i}") for i in range(3000)] + [(None, i, "c", "x") for i in range(1500)] + [(k, 0, "a", "y") for k in range(2, 300)]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    assert shared.hot_keys(d, ["conv_id"]).count() == 2
    assert parity.differences(chat.rotations(d), con, chat.SQL) == []


# 7 personal data -----------------------------------------------------------------


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark):
    texts = [
        "card 4799134681044206 or 4799-1346-8104-4206, not 4799134681044207",
        "mail A.b@Mail9.example.com, a.b@mail9.example.com.",
        "call +1 (988) 555-2485 and 988-555-2485",
        "born 2024-02-29, 29.02.2024, not 2023-02-29",
        "from 82.43.185.109, not 300.1.1.1",
        "GB82 WEST 1234 5698 7654 32",
        "123-45-6789 not 000-12-3456",
        None,
        "",
        "nothing here é",
    ]
    d = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_replaced int")
    out = [(r["text"], r["n_replaced"]) for r in pii.pseudonymise(d, "k").orderBy("doc_id").collect()]
    assert [n for _, n in out] == [2, 2, 2, 2, 1, 1, 1, 0, 0, 0]
    cards = re.findall(r"\d[\d-]{15,}", out[0][0])
    assert luhn(cards[0]) and cards[0] == cards[1].replace("-", "") != "4799134681044206" and cards[2] == "4799134681044207"
    mails = re.findall(r"\S+@\S+?(?=[,.]*(?:\s|$))", out[1][0])
    assert mails[0] == mails[1] and mails[0] != "a.b@mail9.example.com" and mails[0].endswith(".com")
    phones = re.findall(r"\d{3}\)? ?-?\d{3}-\d{4}", out[2][0])
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) and "+1 (" in out[2][0]
    iso, dotted = re.findall(r"\d{4}-\d\d-\d\d", out[3][0])[0], re.findall(r"\d\d\.\d\d\.\d{4}", out[3][0])[0]
    assert iso.split("-") == dotted.split(".")[::-1] and "2023-02-29" in out[3][0]
    assert "300.1.1.1" in out[4][0] and "82.43.185.109" not in out[4][0]
    assert "000-12-3456" in out[6][0]
    assert [t for t, _ in out[7:]] == [None, "", "nothing here é"]
    assert pii.pseudonymise(frame(spark), "k").count() == len(rows()) and pii.pseudonymise(empty(spark), "k").count() == 0


def test_feistel_is_a_permutation(spark):
    n = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    got = {r[0] for r in n.select(pii.feistel_text(F.col("t"), "k", "x")).collect()}
    assert len(got) == 1000 and all(len(x) == 3 and x.isdigit() for x in got)
    days = spark.range(300).select(pii.feistel_number(F.col("id"), "k", "d", 18, 300).alias("x"))
    assert {r[0] for r in days.collect()} == set(range(300))
    other = {r[0] for r in n.limit(50).select(pii.feistel_text(F.col("t"), "k2", "x")).collect()}
    assert other != {r[0] for r in n.limit(50).select(pii.feistel_text(F.col("t"), "k", "x")).collect()}


# 9 toxicity ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def tox(spark):
    g = random.Random(1)
    syll = ["ba", "do", "ki", "le", "mu", "na", "po", "ra", "si", "to"]
    bad = ["stupid", "idiot", "moron", "worthless"]
    docs, labels = [], []
    for i in range(900):
        w = ["".join(g.choice(syll) for _ in range(g.randint(1, 3))) for _ in range(g.randint(5, 40))]
        y = i % 5 == 0
        for _ in range(3 * y):
            w.insert(g.randrange(len(w)), g.choice(bad))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, 0, int(y)))
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return d, lab, toxicity.fit(d, lab)


def test_restoration(tox):
    m = tox[2]
    for raw, want in (("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("stuuuupid", "stupid"), ("w0rth1ess", "worthless"), ("idiot!!!", "idiot")):
        assert want in m.words(raw), raw
    assert m.spaced("you s t u p i d one") == ["stupid"] and m.spaced("i.d.i.o.t") == ["idiot"]
    assert m.words("12345") == [] and m.words("bado") == ["bado"]


def test_scores_hold_out(spark, tox):
    d, lab, _ = tox
    got = toxicity.scored(d, lab).join(lab, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_toxicity_edges(spark, tox):
    _, lab, model = tox
    out = toxicity.score(frame(spark), model, "__s").collect()
    assert len(out) == len(rows()) and all(0 <= r["__s"] <= 1 for r in out)
    bad = spark.createDataFrame([(1, "you 1d10t are s t u p i d and a m0r0n"), (2, None)], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(bad, model).collect()}
    assert s[1] > 0.7 > s[2]
    none = toxicity.scored(empty(spark), lab)
    assert none.count() == 0
    assert toxicity.scored(frame(spark), lab.limit(0)).filter("predicted = 1").count() == 0


# 10 secrets ------------------------------------------------------------------------


def test_base_spans():
    t = 'Token = "0641917ea4e9feb9cda8" x APIKEY:abcdefghijkl AKIAABCDEFGHIJKLMN é password=short 0123456789abcdef'
    base, _ = secrets.scan(t)
    kinds = [(secrets.KINDS[k], t[a:b]) for a, k, b in base]
    assert kinds == [("assign", 'Token = "0641917ea4e9feb9cda8'), ("hex", "0641917ea4e9feb9cda8"), ("assign", "APIKEY:abcdefghijkl"), ("access", "AKIAABCDEFGHIJKLMN"), ("hex", "0123456789abcdef")]
    assert secrets.scan(None) == ([], []) == secrets.scan("")


def test_entropy_windows_match_a_recount():
    g = random.Random(4)
    run = "".join(g.choice("abcdef0123456789XYZ+/") for _ in range(70))
    for at, _, bits in secrets.windows(run):
        c = Counter(run[at : at + secrets.WINDOW])
        assert math.isclose(bits, -sum(n / 20 * math.log2(n / 20) for n in c.values()), abs_tol=1e-9)


def test_entropy_spans_match_a_recount():
    g = random.Random(12)
    sets = ["0123456789", "abcdef0123456789", "abcdefghij", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aAbBcCdDeEfFgGhHiI", "aZ09+/_=-xYq", "aaab"]
    for _ in range(300):
        text = " ".join("".join(g.choice(g.choice(sets)) if g.random() < 0.1 else g.choice(chars) for _ in range(g.randint(15, 70))) for chars in g.choices(sets, k=3))
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            if any(p.fullmatch(m[0]) for p in secrets.ALLOW):
                continue
            covered = set()
            for at in range(len(m[0]) - 19):
                w = m[0][at : at + 20]
                bits = -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values())
                least = next(t for _, chars, t in secrets.CLASSES if set(w) <= chars)
                if bits >= least - 1e-9:
                    covered |= set(range(m.start() + at, m.start() + at + 20))
            edges = sorted(covered)
            starts = [x for x in edges if x - 1 not in covered]
            want += [(x, next(y for y in range(x, len(text) + 1) if y not in covered)) for x in starts]
        # touching windows of one string are one span here and two there
        got = set()
        for a, b in secrets.entropy_spans(text):
            got |= set(range(a, b))
        assert got == {x for a, b in want for x in range(a, b)}


def test_entropy_adds_and_allow_list_suppresses():
    key = "q7Zt9xLw2Vb8Nc4Rk6Jm1Hs3"
    assert [k for _, k, _ in secrets.scan(f"see {key} there")[1]] == [3]
    for fine in ("123e4567-e89b-12d3-a456-426614174000", "internationalisation-and-localisation", "aaaaaaaaaaaaaaaaaaaaaaaa", "4799134681044206479913"):
        assert not [s for s in secrets.scan(fine)[1] if s[1] == 3], fine


def test_secrets_edges(spark):
    out = secrets.find_secrets(frame(spark)).collect()
    assert len(out) == len(rows())
    assert {r["base_sha256"] for r in out if r["doc_id"] in (3, 4)} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.find_secrets(empty(spark)).count() == 0


# shared ----------------------------------------------------------------------------


def test_prefix_sum(spark):
    g = random.Random(8)
    data = [(g.choice([None, "a", "b"]), g.choice([None, 1, 2, 3]), g.randrange(3), i, g.randrange(9)) for i in range(300)]
    d = spark.createDataFrame(data, "g string, l1 int, l2 int, o int, v long")
    got = {r["o"]: r["before"] for r in shared.prefix_sum(d, ["g"], ["l1", "l2"], [F.col("o")], "v", "before").collect()}
    for grp in (None, "a", "b"):
        at = 0
        for _, _, _, o, v in sorted((r for r in data if r[0] == grp), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
            assert got[o] == at
            at += v


def test_written_frames_can_be_cleaned(spark):
    import os

    df = shared.materialise(spark.range(3).toDF("x"), "t")
    assert df.count() == 3
    place = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(place)


def test_sizes_of_batches_are_kept_in_any_unit(spark):
    kept = spark.conf.get(shared.BATCH, None)
    try:
        for size in ("1g", "64k", "3m", "1048576"):
            spark.conf.set(shared.BATCH, size)
            assert shared.bounded(spark.range(1)) is not None and spark.conf.get(shared.BATCH) == size
    finally:
        spark.conf.set(shared.BATCH, kept) if kept else spark.conf.unset(shared.BATCH)


def test_written_frames_are_forgotten(spark):
    import os

    since = shared.written()
    a, b = (shared.materialise(spark.range(n).toDF("x"), "t") for n in (3, 4))
    places = [df.inputFiles()[0].removeprefix("file://") for df in (a, b)]
    shared.forget(spark, since)
    assert [os.path.exists(x) for x in places] == [False, True] and b.count() == 4
    shared.forget(spark, since)
    assert shared.written() == since + 1 and b.count() == 4


def test_base_text_is_long_enough():
    assert len(BASE.split()) > 25
