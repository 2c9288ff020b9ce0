"""Disguised words that are long, all signs or doubled letters."""

from __future__ import annotations

import random

import numpy as np
import pytest

from finweave.llm import toxicity


@pytest.fixture(scope="module")
def model():
    g = random.Random(1)
    words = ["stupid", "idiot", "moron", "worthless", "shit", "ass", "all", "sito", "bado"]
    s = toxicity.symbols(" " + " ".join(g.choices(words, k=5000)) + " ").astype(np.int64)
    n = toxicity.SYMBOLS
    return toxicity.Model(toxicity.language_model(np.bincount((s[:-2] * n + s[1:-1]) * n + s[2:], minlength=n**3).astype(float)))


@pytest.mark.parametrize("mark", "_.*")
def test_long_joined_words(model, mark):
    token = mark.join(["1d10t", "$tup1d", "m0r0n", "w0rth1ess"] * 6)
    assert len(token) > 64
    assert {"idiot", "stupid", "moron", "worthless"} <= set(model.words(token))


@pytest.mark.parametrize(("token", "word"), [("4$$", "ass"), ("$#1+", "shit"), ("a$$", "ass"), ("$!+0", "sito"), ("stuupid", "stupid"), ("idiiot", "idiot")])
def test_signs_and_doubled_letters(model, token, word):
    assert word in model.words(token)


def test_plain_tokens_stay(model):
    for token in ("12345", "$1,200.50", "100€", "+49", "2024-01-15", "!!!", "$$$", "--", "1/2"):
        assert model.words(token) == [], token
    assert model.words("all") == ["all"] and model.words("bado!") == ["bado"]
    assert "stuupid" in model.words("stuupid")


def every_path(model, token):
    """The least cost over all ways through the lattice, and the readings that have it."""
    lm, best = model.lm, {}

    def go(i, a, b, kept, out, cost):
        if i == len(token):
            total = cost + lm[a, b, 0]
            best[out] = min(best.get(out, total), total)
            return
        c = token[i]
        if c.isalpha():
            s = toxicity.symbol(c)
            go(i + 1, b, s, c, out + c, cost + lm[a, b, s])
            if kept == c:
                go(i + 1, a, b, kept, out, cost + toxicity.REPEAT)
            return
        for z in toxicity.LEET.get(c, ""):
            s = toxicity.symbol(z)
            go(i + 1, b, s, z, out + z, cost + lm[a, b, s] + toxicity.SWAP)
            if kept == z and i and token[i - 1] == c:
                go(i + 1, a, b, kept, out, cost + toxicity.REPEAT)
        go(i + 1, a, b, kept, out, cost + (toxicity.DROP if c in toxicity.LEET else 0.0))
        if c not in toxicity.LEET and b:
            go(i + 1, b, 0, "", out + " ", cost + lm[a, b, 0] + toxicity.BORDER)

    go(0, 0, 0, "", "", 0.0)
    least = min(best.values())
    return {x for x, v in best.items() if v <= least + 1e-9}


def test_search_finds_the_best_of_all_paths(model):
    g = random.Random(17)
    for _ in range(400):
        token = "".join(g.choice("stupidaso1034$@!|+.-_*é77") for _ in range(g.randint(1, 9)))
        assert model.restore(token) in every_path(model, token), token
