"""Chunks are cut slice by slice: what a worker holds has a bound."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from finweave.operators import batches, text


def test_slices_hold_all_rows_in_order():
    sizes = [0, 5, 3, 50, None, 1, 1, 9, 12, 0]
    b = pa.RecordBatch.from_pydict({"text": [None if n is None else "x" * n for n in sizes]})
    parts = list(batches.slices([b, b.slice(3, 4)], limit=10))
    assert [t for p in parts for t in p["text"].to_pylist()] == b["text"].to_pylist() + b["text"].to_pylist()[3:7]
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= 10 for p in parts)


def test_packing_works_on_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i == 3 else "One two. Three four! " * i) for i in range(40)], "document_id long, text string").coalesce(1)
    want = {(r["document_id"], r["chunk_index"], r["text"]) for r in text.sentence_chunks(docs, 50, 10).collect()}
    assert want == {(r["document_id"], i, c) for r in docs.collect() for i, c in enumerate(text.packed((r["text"] or "").strip(), 50, 10))}
    plan = text.sentence_chunks(docs).select(F.count("text"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
