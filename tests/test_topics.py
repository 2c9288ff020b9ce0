"""The topics query fits on all documents with the operator's defaults."""

from __future__ import annotations

from finweave import plans
from finweave.operators import text

SF = "/root/testdata/sf0.001"


def test_topics_see_all_documents(spark, monkeypatch):
    monkeypatch.setattr(text, "topics", lambda docs, **changed: (docs.count(), changed))
    assert plans.queries()["corpus_topics"](spark, SF) == (spark.read.parquet(f"{SF}/documents.parquet").count(), {})
