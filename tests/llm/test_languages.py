"""The random field against enumeration and differences; held-out accuracy."""

from __future__ import annotations

import itertools
import zlib

import edges
import numpy as np
import pyarrow as pa
import pytest

from finweave.llm import languages, queries

SF = "/root/testdata/sf0.001"


def enumerated(scores, a, s):
    n, wide = scores.shape
    z, one, two = 0.0, np.zeros((n, wide)), np.zeros((wide, wide))
    for y in itertools.product(range(wide), repeat=n):
        p = np.exp(s[y[0]] + sum(scores[i, k] for i, k in enumerate(y)) + sum(a[i, j] for i, j in itertools.pairwise(y)))
        z += p
        for i, k in enumerate(y):
            one[i, k] += p
        for i, j in itertools.pairwise(y):
            two[i, j] += p
    return one / z, two / z, np.log(z)


@pytest.fixture
def field():
    rng = np.random.default_rng(0)
    return rng, rng.normal(size=(3, 3)), rng.normal(size=3)


def test_marginals(field):
    rng, a, s = field
    sizes = [1, 6, 3]
    real, scores = np.arange(6) < np.array(sizes)[:, None], rng.normal(size=(3, 6, 3)) * 2
    one, two, log_z = languages.forward_backward(scores, a, s, real)
    want = [enumerated(scores[k, :n], a, s) for k, n in enumerate(sizes)]
    assert all(np.allclose(one[k, :n], want[k][0]) and not one[k, n:].any() for k, n in enumerate(sizes))
    assert np.allclose(two, sum(w[1] for w in want)) and np.isclose(log_z, sum(w[2] for w in want))


def test_gradient_of_the_partition_function(field):
    rng, a, s = field
    real, scores = np.ones((2, 5), bool), rng.normal(size=(2, 5, 3))
    one, two, _ = languages.forward_backward(scores, a, s, real)
    for i, j in itertools.product(range(3), range(3)):
        up, down = a.copy(), a.copy()
        up[i, j] += 1e-5
        down[i, j] -= 1e-5
        assert np.isclose((languages.forward_backward(scores, up, s, real)[2] - languages.forward_backward(scores, down, s, real)[2]) / 2e-5, two[i, j], atol=1e-6)


@pytest.mark.parametrize("stride", [1, 3, 64])
def test_cut_chains_are_whole_chains(field, monkeypatch, stride):
    rng, a, s = field
    monkeypatch.setattr(languages, "STRIDE", stride)
    model = languages.Model(list("abc"), {}, np.zeros(0, np.uint64), np.zeros((0, 3)), a, s)
    for _ in range(20):
        borders = np.append(0, np.cumsum(rng.integers(0, 20, size=7)))
        scores = rng.normal(size=(borders[-1], 3)) * 4
        got = languages.chain(model, scores, borders)
        for x, y in itertools.pairwise(borders):
            if y > x:
                assert np.allclose(got[x:y], languages.forward_backward(scores[None, x:y], a, s, np.ones((1, y - x), bool))[0][0])


def test_words():
    names, codes, borders = languages.words_of(pa.array(["  Ab, ab-ÉT!", None, "", "42 .", "x"]))
    assert [names[c] for c in codes] == ["ab", "ab", "ét", "x"] and borders.tolist() == [0, 3, 3, 3, 3, 4]


def test_features_of_words():
    """Keys part what differs and join what is equal, against plain sets of substrings."""
    words = ["ab", "abab", "ba", "étude", "x", "a\U0001f600b", "étuden"]
    owner, key = languages.word_features(words)
    seen = {}
    for i, w in enumerate(words):
        plain = [("p", w[:n]) for n in range(1, 5) if n <= len(w)] + [("s", w[-n:]) for n in range(1, 5) if n <= len(w)] + [(n, f"^{w}$"[k : k + n]) for n in (2, 3) for k in range(len(w) + 3 - n)]
        mine = sorted(key[owner == i].tolist())
        assert len(mine) == len(plain)
        seen[i] = (set(plain), set(mine))
    for i in seen:
        for j in seen:
            assert len(seen[i][0] & seen[j][0]) == len(seen[i][1] & seen[j][1])


def test_code_switched_text(spark):
    """A text in two halves of two languages: runs tell the switch, the longer part the language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.fit(docs)
    held = {lang: [r["text"] for r in docs.filter(languages.held_out(docs["doc_id"])).filter(docs["lang"] == lang).orderBy("doc_id").limit(6).collect() if r["text"]] for lang in ("en", "de")}
    word = lambda lang, n: " ".join(" ".join(held[lang]).split()[:n])
    mixed = spark.createDataFrame([(1, word("en", 200) + ". " + word("de", 80)), (2, word("de", 200) + ". " + word("en", 80))], "doc_id long, text string")
    for r, order in zip(languages.identify(mixed, model).orderBy("doc_id").collect(), (("en", "de"), ("de", "en")), strict=True):
        assert r["lang_pred"] == order[0]
        total = sum(x["words"] for x in r["runs"])
        right = sum(max(0, min(x["first"] + x["words"], b) - max(x["first"], a)) for x in r["runs"] for k, (a, b) in enumerate(((0, int(total * 200 / 280)), (int(total * 200 / 280), total))) if x["lang"] == order[k])
        assert right >= 0.9 * total


def test_held_out_accuracy_and_reruns(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13_languages(spark, sf).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) >= 0.97 * len(held)
    assert sorted(map(tuple, queries.op13_languages(spark, sf).collect())) == sorted(map(tuple, rows))


def test_nothing_of_a_held_out_row_is_used(spark):
    """Other languages and texts on held-out rows, and other ids, leave what is learned as it is."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = docs.withColumns({c: languages.F.when(languages.held_out(docs["doc_id"]), "xx").otherwise(docs[c]) for c in ("lang", "text")})
    a, b = languages.fit(docs), languages.fit(odd)
    assert a.languages == b.languages and a.keys.tolist() == b.keys.tolist() and np.allclose(a.weights, b.weights)


def test_awkward_tables(spark):
    docs = edges.frame(spark)
    rows = languages.identified(docs).collect()
    assert len(rows) == len(edges.rows())
    for r in rows:
        if r["doc_id"] in (3, 4, 5):
            assert (r["lang_pred"], r["score"], r["runs"]) == ("und", 0.0, [])
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert languages.identified(edges.empty(spark)).collect() == []
    unknown = docs.withColumn("lang", languages.F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in languages.identified(unknown).collect()} == {("und", 0.0)}
    one = docs.withColumn("lang", languages.F.lit("zz"))
    assert {(r["lang_pred"], r["score"]) for r in languages.identified(one).collect()} == {("zz", 1.0), ("und", 0.0)}
    odd = spark.createDataFrame([(1, "ab" * 200_000, "en"), (2, "́ ́", "en"), (3, "١٢٣ 中文字", "de")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in languages.identified(odd).orderBy("doc_id").collect()][1] == "und"
