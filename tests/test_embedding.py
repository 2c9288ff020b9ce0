"""Hashed embeddings: rows by themselves, repeated ids, and no exchange of words."""

from __future__ import annotations

import pytest

from finweave.operators import retrieval

ROWS = [(1, "a b\tb c"), (2, "Profit profit PROFIT margin"), (2, "margin fell"), (3, ""), (4, None), (5, "  \n "), (None, "x"), (None, "x y"), (6, None), (6, "z"), (7, "été"), (8, "one")]


def rows_of(df):
    return sorted(((r["id"], pytest.approx(r["embedding"], abs=1e-12)) for r in df.collect()), key=lambda r: str(r[0]))


@pytest.mark.parametrize("few", [100_000, 1])
@pytest.mark.parametrize("size", [64, 7])
def test_equals_the_aggregate(spark, monkeypatch, few, size):
    monkeypatch.setattr(retrieval, "FEW", few)
    docs = spark.createDataFrame(ROWS, "id long, text string")
    want = [(r["id"], r["embedding"]) for r in sorted(retrieval._added(docs, size).collect(), key=lambda r: str(r["id"]))]
    assert want == rows_of(retrieval.embed(docs, size)) and len(want) == 6


def test_words_are_not_exchanged(spark):
    docs = spark.createDataFrame(ROWS[:2] + ROWS[3:6], "id long, text string")
    assert "Exchange" not in retrieval.embed(docs)._jdf.queryExecution().executedPlan().toString()
