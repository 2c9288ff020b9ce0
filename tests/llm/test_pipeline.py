from __future__ import annotations

import corpus_pipeline
import edges
import pytest
from pyspark.sql import functions as F

from finweave.llm import near, toxicity
from finweave.llm.shared import materialise

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "packing":
            assert sorted(docs.columns) == sorted(before.columns)
    scores = toxicity.scored(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert {r[0] for r in kept["toxicity"].select("doc_id").collect()} == {r[0] for r in scores.filter("predicted = 0").select("doc_id").collect()}
    classes = near.near_duplicates(kept["toxicity"])
    assert kept["near_duplicates"].count() == classes.select("class_id").distinct().count()
    assert kept["personal_data"].filter(F.col("text").rlike(r"@mail\d\.example\.com")).count() == 0
    assert kept["packing"].select("doc_id").distinct().count() == kept["mixing"].select("doc_id").distinct().count()
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, kept["packing"].select("doc_id", "piece", "ids_crc32").collect()))


@pytest.mark.parametrize("rows", ["frame", "empty"])
def test_awkward_tables(spark, rows):
    """Nulls, empty and very long texts, repeated rows and clashing names pass all stages; an empty table stays empty."""
    docs = getattr(edges, rows)(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = materialise(stage(spark, docs, SF), f"awkward-{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    if rows == "empty":
        assert all(d.count() == 0 for d in kept.values())
        return
    ids = lambda name: sorted((r[0] is None, r[0]) for r in kept[name].select("doc_id").collect())
    assert len(ids("toxicity")) == len(edges.rows())
    once = {(r[0] is None, r[0]) for r in edges.rows()} - {(False, 1), (False, 2)}  # equal and near to 0; of 3, 4 and 5, which have no word, only equal ones go
    assert set(ids("near_duplicates")) <= once and {(False, k) for k in (0, 6, 7, 8, 9, 10)} <= set(ids("near_duplicates")) and (True, None) in ids("near_duplicates")
    assert ids("personal_data") == ids("near_duplicates") and set(ids("mixing")) <= set(ids("personal_data"))
    pieces = kept["packing"].collect()
    assert {(r["doc_id"] is None, r["doc_id"]) for r in pieces} == set(ids("mixing"))
    spans: dict = {}
    for r in pieces:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
