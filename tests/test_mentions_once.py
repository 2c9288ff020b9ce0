"""Names and lexicon words are sorted once by document and place."""

from __future__ import annotations

from finweave.operators import mentions
from finweave.plans import texts

SF = "/root/testdata/sf0.001"


def test_one_pass_of_the_texts(spark):
    plan = mentions.entity_sentiment(texts.documents(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "Join" not in plan
