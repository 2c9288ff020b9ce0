"""Recall of entropy spans on generated secrets of every class."""

from __future__ import annotations

import math
import random
import string
import time
from collections import Counter

import pytest

from finweave.llm import secrets

KINDS = {"lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "letters": string.ascii_letters, "hex": "0123456789ABCDEF", "digits": string.digits, "base64": string.ascii_letters + string.digits + "+/"}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("length", [20, 32])
def test_random_secrets_are_found(kind, length):
    g = random.Random(length)
    found = sum(bool(secrets.scan(f"see {''.join(g.choices(KINDS[kind], k=length))} there")[1]) for _ in range(500))
    assert found >= 0.92 * 500


def test_digit_windows_are_judged():
    bits = next(least for name, _, least in secrets.CLASSES if name == "digits")
    g = random.Random(6)
    hits = sum(next(secrets.windows("".join(g.choices(string.digits, k=20))))[2] >= bits for _ in range(500))
    assert hits >= 0.92 * 500


@pytest.mark.parametrize("text", ["auth=QZrTfWkPxLmVbNhJgYdScAeUo", "sk_QZrTfWkPxLmVbNhJgYdScAeUo", "2024-01-15_9fK2xQ7LmZ81vTbWqR4y"])
def test_labels_and_dates_hide_no_key(text):
    assert [k for _, k, _ in secrets.scan(text)[1]] == [3]


@pytest.mark.parametrize("text", ["2024-01-15T10-30-00Z", "2024-01-15/2024-02-01", "2024-01-15-quarterly-report-final", "the-quick-brown-fox-jumps-over", "src/main/java/org/example/app", "Total_Revenue_And_Net_Income"])
def test_dates_and_joined_words_are_no_secrets(text):
    assert secrets.scan(text) == ([], [])


@pytest.mark.parametrize("text", ["=" * 30 + "Introduction", "_" * 40 + "Signature/date", "iVBORw0KGgo" + "A" * 24 + "CAYAAAB6", "a" * 500, "0" * 21, "-" * 2_000_000])
def test_long_runs_of_one_character(spark, text):
    rows = secrets.find_secrets(spark.createDataFrame([(1, f"see {text} there")], "doc_id long, text string")).collect()
    assert len(rows) == 1
    runs = list(secrets.windows(text[:600]))
    assert all(abs(bits - entropy(text[i : i + 20])) < 1e-9 for i, _, bits in runs)


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


@pytest.mark.parametrize("text", ["2024-01-15" + "T" * 5000 + "123456789x", "2024-01-15" + "-a1" * 3000 + "!", "/" + "a1-" * 5000 + "?", "a-" * 20_000 + "1x", "AKIA" * 20_000, "a=" * 30_000])
def test_no_pattern_backtracks(text):
    began = time.process_time()
    secrets.scan(text)
    assert time.process_time() - began < 3


def test_dashed_keys_are_found():
    g = random.Random(8)
    chars = string.ascii_lowercase + string.digits
    keys = ["-".join("".join(g.choices(chars, k=8)) for _ in range(4)) for _ in range(500)] + ["-".join("".join(g.choices(chars, k=8)) for _ in range(3)) + "-" + "".join(g.choices(string.ascii_lowercase, k=8)) for _ in range(500)]
    assert sum(bool(secrets.scan(f"key {k} end")[1]) for k in keys) >= 0.95 * len(keys)


def test_spans_within_base_spans_are_told_once():
    g = random.Random(2)
    for _ in range(300):
        text = " ".join(g.choice([f"token={''.join(g.choices(string.ascii_letters, k=30))}", "".join(g.choices("0123456789abcdef", k=24)), "AKIA" + "".join(g.choices(string.ascii_uppercase + string.digits, k=20)), "".join(g.choices(string.ascii_letters + string.digits, k=26))]) for _ in range(6))
        base = secrets.base_spans(text)
        want = [(a, 3, b) for a, b in secrets.entropy_spans(text) if not any(s <= a and b <= e for s, _, e in base)]
        assert secrets.scan(text) == (base, sorted(base + want))
