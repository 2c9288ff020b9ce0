"""Places of tokens by distinct words, against the tokenizer on whole texts."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq

from finweave.operators import token_windows as tw

PATH = public_tokenizers.path("word_bpe_49k.json")
BLANKS = [" ", " ", " ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\xa0", " ", "　", "\x85", "\x1c", "​", " ", ""]
WORDS = ["Profit", "it's", "IT'S", "we'll", "'s", "4.5%", "Zürich", "Zürich", "̈x", "q̣̇", "q̣̇", "東京", "\U0001f600", "İstanbul", "ΑΣ", "ﬁn", "\x00", "á֮̀̕b", "<|x", "--", "...", "(it's", "'string", "a'Vest", "x≠", "e'́", "word,next", "_a_1b", "O''s", "각", "क़"]


def whole(text):
    return [a for a, _ in tw.tokenizer(PATH).encode(text, add_special_tokens=False).offsets]


def test_random_texts():
    assert tw.by_word(PATH) and not tw.by_word(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(3)
    for _ in range(3_000):
        text = "".join(draw.choice(BLANKS) + draw.choice(WORDS) for _ in range(draw.randrange(1, 30))) + draw.choice(BLANKS)
        assert tw.begins_of(text, PATH).tolist() == whole(text), repr(text)


def test_documents_and_a_small_store(monkeypatch):
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    want = [whole(t) for t in texts]
    monkeypatch.setattr(tw, "WORDS", 50)
    assert [tw.begins_of(t, PATH).tolist() for t in texts] == want


def test_added_tokens_take_the_plain_way():
    for text in ("a <|endoftext|> b", "a<|endoftext|>", "<|startoftext|>\n<|"):
        assert tw.begins_of(text, PATH).tolist() == whole(text)


def test_repeated_words_are_encoded_once():
    text = " ".join(np.random.default_rng(1).choice(["profit", "margin", "grew", "fell", "again,"], 60_000))
    began = time.perf_counter()
    want = whole(text)
    plain = time.perf_counter() - began
    began = time.perf_counter()
    got = tw.begins_of(text, PATH)
    assert time.perf_counter() - began < plain / 3 and got.tolist() == want
