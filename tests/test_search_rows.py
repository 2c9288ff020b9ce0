"""The rows of the search come from statements that are kept."""

from __future__ import annotations

from finweave.plans import models

SF = "/root/testdata/sf0.001"


def test_statements_are_made_once(spark):
    rows = models.search_rows(spark, SF)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan
    assert rows.count() > 0
