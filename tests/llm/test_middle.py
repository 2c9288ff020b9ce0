"""Fill-in-the-middle against plain string work."""

from __future__ import annotations

import hashlib
import random
import re

import edges

from finweave.llm import middle


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in range(0, 32, 8)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(lines), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def test_cuts_and_restoration():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("ab\n\n\ré€\U0001f600<SPM> ") for _ in range(rng.randint(0, 40)))
        raw, h1, h2 = text.encode(), rng.getrandbits(32), rng.getrandbits(32)
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        n, a, b = middle.cuts(raw, h1, h2)
        i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
        assert (n, raw[:a].decode(), raw[a:b].decode()) == (len(lines), "".join(lines[:i]), "".join(lines[i:j]))
        assert middle.code_points(raw, a, b) == len("".join(lines[i:j]))
        if not any(x in text for x in ("<P>", "<S>", "<M>")):
            for form in ("psm", "spm", "plain"):
                assert middle.restored(middle.joined(raw, form, a, b), form) == raw


def test_select_is_the_place_of_a_rank():
    rng = random.Random(4)
    for _ in range(300):
        width = rng.randint(1, 400)
        bits = rng.getrandbits(width)
        assert [middle.select(bits, k, width) for k in range(bits.bit_count())] == [i for i in range(width) if bits >> i & 1]


def test_awkward_tables(spark):
    rows = [(r[0], r[1]) for r in edges.rows()] + [(k, t) for k, t in enumerate(["\n", "\n\n\n", "a\n", "\na", "x<S>y\nz", "<\nP>\n", "a\r\nb c\n" * 2000], 50)]
    docs = spark.createDataFrame([(d, t, 5, "f", "o") for d, t in rows], "doc_id long, text string, n int, form string, output string")
    for rate, spm in ((100, 50), (60, 100), (0, 50)):
        got = middle.fill_in_middle(docs, 7, rate, spm).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, ((d, *plain(d, t, rate, spm)) for d, t in rows)))
    assert middle.digest(middle.fill_in_middle(edges.empty(spark))).collect() == []
