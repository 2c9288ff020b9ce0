"""Token windows against the tokenizer itself."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

from finweave.operators import token_windows

FILES = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]


def texts():
    g = random.Random(1)
    words = ["Profit", "grew", "by", "4.5%", "in", "Zürich", "and\n\n", "  twice", "東京", "\U0001f600", "don't", "aaaaaaaaaaaaaaaaaaaaaaa"]
    return [" ".join(g.choices(words, k=g.randint(1, 400))) for _ in range(12)] + [None, "", "   ", "one"]


@pytest.mark.parametrize("path", FILES)
def test_windows_join_to_the_text(spark, path):
    given = texts()
    docs = spark.createDataFrame(list(enumerate(given)), "document_id int, text string")
    count = {r["document_id"]: (r["characters"], r["tokens"]) for r in token_windows.sizes(docs, path).collect()}
    t = token_windows.tokenizer(path)
    found: dict = {}
    for r in token_windows.windows(docs, path, 40, 7).orderBy("document_id", "chunk_index").collect():
        found.setdefault(r["document_id"], []).append(r)
    for i, text in enumerate(given):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert count[i] == (len(text or ""), n)
        rows = found.get(i, [])
        if not n:
            assert not rows
            continue
        assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and all(r["tokens"] == 40 for r in rows[:-1]) and sum(r["tokens"] - r["prev_overlap"] for r in rows) == n
        assert [r["prev_overlap"] for r in rows] == [0] + [7] * (len(rows) - 1) and [r["next_overlap"] for r in rows] == [7] * (len(rows) - 1) + [0]
        assert all(r["text"] == text[r["start"] : r["stop"]] for r in rows)
        assert "".join(text[r["start"] : nxt] for r, nxt in zip(rows, [*[r["start"] for r in rows[1:]], len(text)], strict=True)) == text


@pytest.mark.parametrize("path", FILES)
def test_parts_have_the_tokens_of_the_whole(path):
    text = " ".join(x for x in texts() if x) * 3
    whole = [a for a, _ in token_windows.tokenizer(path).encode(text, add_special_tokens=False).offsets]
    assert token_windows.offsets(text, path, 200).tolist() == whole and len(list(token_windows.parts(text, 200))) > 10


def test_overlap_must_be_less(spark):
    with pytest.raises(ValueError):
        token_windows.windows(spark.createDataFrame([(1, "a")], "document_id int, text string"), FILES[0], 5, 5)


def test_query_over_whole_tables(spark):
    from finweave.plans import texts as plans

    sf = "/root/testdata/sf0.001"
    t = token_windows.tokenizer(FILES[0])
    count = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(d, k) for d, n in count.items() for k in range(1 + max(0, -(-(n - 512) // 448)) if n else 0)}
    assert {(r["document_id"], r["chunk_index"]) for r in plans.token_chunks(spark, sf).collect()} == want
