"""The registered queries over whole small tables against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import parity
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from finweave.llm import near, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    t = Tokenizer.from_file(queries.WORD_BPE)
    return {d: t.encode(x, add_special_tokens=False).ids for d, x in texts.items()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    assert parity.differences(queries.QUERIES[name](spark, SF), parity.connect(SF), queries.ORACLES[name]) == []


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_streams(spark, texts):
    rows = queries.op2_transport_streams(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        data = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert r["media_bytes"] % 188 == 0 and "cc_errors=0" in r["feature"]


def test_near_duplicates(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = near.document_frequencies(docs)
    order = sorted(texts)
    vec = {}
    for d in order:
        runs, times, _ = near.shingles(*near.word_hashes(pa.array([texts[d]])))
        vec[d] = (runs, weights.of(runs, times))
    parent = {d: d for d in order}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(order, 2):
        if texts[a] == texts[b] or near.weighted_jaccard(vec[a], vec[b]) >= 0.8:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert dict(queries.op3_near_duplicates(spark, SF).collect()) == {d: find(d) for d in order}


def test_packing(spark, ids):
    rows = queries.op4_best_fit_packing(spark, SF).collect()
    want = {(d, k // 2048, k, len(y), crc(y)) for d, x in ids.items() for k in range(0, len(x) + 1, 2048) for y in [[*x, 0][k : k + 2048]]}
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 2048
    assert len(seqs) <= 1.05 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_neighbours(spark):
    e = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    names = np.array(sorted(e))
    x = np.stack([e[i] for i in names])
    norm = np.linalg.norm(x, axis=1)
    rows = queries.op5_nearest_vectors(spark, SF).collect()
    asked = [i for i in names if i % 50 == 0]
    assert len(rows) == 5 * len(asked)
    hits = 0
    for q in asked:
        s = x @ e[q] / (norm * np.linalg.norm(e[q]))
        s[names == q] = -9
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert all(abs(s[list(names).index(v)] - sc) < 1e-12 for _, v, sc in mine)
        hits += len({v for _, v, _ in mine} & set(names[np.argsort(-s)[:5]]))
    assert hits >= 0.9 * 5 * len(asked)


def test_token_files(spark, ids):
    at, want = 0, []
    for d in sorted(ids):
        x = [*ids[d], 2]
        want.append((d, at, len(x), crc(x)))
        at += len(x)
    assert sorted(map(tuple, queries.op8_token_files(spark, SF).collect())) == want


def test_toxicity(spark, texts):
    rows = queries.op9_toxicity(spark, SF).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == len(texts) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.85 * len(held)
    assert sorted(map(tuple, queries.op9_toxicity(spark, SF).collect())) == sorted(map(tuple, rows))
    assert toxicity.held_out.__module__ == "finweave.llm.toxicity"


def test_secrets(spark, texts):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in queries.op10_secrets(spark, SF).collect():
        t = texts[r["doc_id"]]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))
