"""Sentiment about names against a plain reading; the index over reruns and changes."""

from __future__ import annotations

import random
import re

import pytest

from finweave.operators import mentions
from finweave.sources.index import Index


def plain(text, positive, negative, reach=10):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    core = [re.sub(r"^[\W\d_]+|[\W\d_]+$", "", w) for w in words]
    spans, run = [], []
    for i, w in enumerate(words):
        big = len(core[i]) > 1 and core[i][0].isupper() and core[i][1:].islower() and core[i].isalpha()
        if not big or (run and not words[i - 1][-1].isalpha()):
            spans.append(run)
            run = []
        if big:
            run.append(i)
    spans.append(run)
    out = {}
    for s in spans:
        if len(s) > 1:
            near = [c.lower() for c in core[max(0, s[0] - reach) : s[-1] + reach + 1]]
            p, n = sum(c in positive for c in near), sum(c in negative for c in near)
            out.setdefault(" ".join(core[i] for i in s), []).append((p, n, (p - n) / (p + n) if p + n else 0.0))
    return {k: (len(v), sum(x[0] for x in v), sum(x[1] for x in v), sum(x[2] for x in v) / len(v)) for k, v in out.items()}


def test_sentiment_about_names(spark):
    g = random.Random(3)
    word = lambda: g.choice(["Acme", "Corp", "Élan", "Vital", "growth", "Loss,", "loss", "strong", "the", "of", "(risk)", "Gain.", "weak", "a", "42", "Über", "Inc.", "profit!"])
    texts = [" ".join(word() for _ in range(g.randint(0, 200))) for _ in range(40)] + [None, "", "Acme Corp", "  Acme  Corp\nElan growth ", "Acme, Corp loss", "Acme Corp " + "x " * 10 + "growth", "Acme Corp " + "x " * 9 + "growth", " ".join(["Acme"] * 3000)]
    got: dict = {}
    for r in mentions.entity_sentiment(spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")).collect():
        got.setdefault(r["document_id"], {})[r["entity"]] = (r["mentions"], r["positive"], r["negative"], r["sentiment"])
    for i, t in enumerate(texts):
        want = plain(t, mentions.K.POSITIVE, mentions.K.NEGATIVE)
        mine = got.get(i, {})
        assert mine.keys() == want.keys() and all(mine[k][:3] == want[k][:3] and abs(mine[k][3] - want[k][3]) < 1e-12 for k in want)


def filings(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "ticker string, fiscal_year int, document_id string, text string, extra string")


@pytest.fixture
def base():
    return [(t, y, f"{t}{y}{k}", f"{t} {y} {k} " * 200) for t in ("A", "B") for y in (2020, 2021) for k in range(3)]


def stamps(folder):
    return {p.relative_to(folder): p.stat().st_mtime_ns for p in folder.rglob("part-*.parquet")}


def test_builds_again_write_nothing_and_changes_one_partition(spark, tmp_path, base):
    index = Index(f"file://{tmp_path}/index", 300, 50)
    assert index.chunks(spark).count() == 0
    assert index.build(filings(spark, base)) == 4
    first = stamps(tmp_path)
    assert index.build(filings(spark, base[::-1])) == 0 and stamps(tmp_path) == first
    changed = [(t, y, d, x + "!" if d == "A20211" else x) for t, y, d, x in base]
    assert [tuple(r) for r in index.pending(filings(spark, changed)).collect()] == [("A", 2021)]
    assert index.build(filings(spark, changed)) == 1
    after = stamps(tmp_path)
    assert {str(p.parent) for p in first.keys() ^ after.keys()} == {f"index/{n}/ticker=A/fiscal_year=2021" for n in ("chunks", "manifest")}
    assert all(after[p] == first[p] for p in first.keys() & after.keys())
    for t, y, d, x in changed:
        found = sorted((r["chunk_index"], r["text"]) for r in index.chunks(spark).filter(f"document_id = '{d}'").collect())
        assert [c for _, c in found] == [x[i : i + 300] for i in range(0, len(x), 250)]


def test_parts_of_the_filings_leave_the_rest(spark, tmp_path, base):
    index = Index(f"file://{tmp_path}/index")
    index.build(filings(spark, base))
    more = [("A", 2020, "A20200", "new"), ("C", 2022, "c", None), ("C", 2022, "c", None), (None, 2022, "d", "x"), ("C", None, "d", "x"), ("C", 2022, None, "x")]
    assert index.build(filings(spark, more)) == 2
    known = {(r["ticker"], r["fiscal_year"], r["document_id"]): r["chunks"] for r in index.manifest(spark).collect()}
    assert known[("A", 2020, "A20200")] == 1 and ("A", 2020, "A20201") not in known and known[("C", 2022, "c")] == 0 and len(known) == 11
    assert {r[0] for r in index.chunks(spark).filter("ticker = 'A' and fiscal_year = 2020").select("text").collect()} == {"new"}
    assert index.build(filings(spark, more)) == 0 and Index(index.root, 100, 10).build(filings(spark, more)) == 2


def test_a_build_that_was_cut_off(spark, tmp_path, base, monkeypatch):
    """Chunks were written, the manifest not: readers see the old state, the next build makes it good."""
    index = Index(f"file://{tmp_path}/index")
    index.build(filings(spark, base))
    changed = [(t, y, d, "other" if d == "B20202" else x) for t, y, d, x in base]
    before = index.manifest(spark).collect()
    saved = tmp_path / "saved"
    (tmp_path / "index" / "manifest").rename(saved)
    index.build(filings(spark, changed))
    done = tmp_path / "index" / "manifest"
    done.rename(tmp_path / "gone")
    saved.rename(done)
    assert sorted(map(tuple, index.manifest(spark).collect())) == sorted(map(tuple, before))
    assert index.chunks(spark).filter("text = 'other'").count() == 0
    assert index.build(filings(spark, changed)) == 1 and index.chunks(spark).filter("text = 'other'").count() == 1
