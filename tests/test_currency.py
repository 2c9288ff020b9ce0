"""Balances as text on awkward values equal the statement."""

from __future__ import annotations

import parity
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from finweave import plans
from finweave.operators import reports

VALUES = [-0.0, 0.0, -0.004, 0.004, 0.125, 0.375, 2.675, 999.995, -999.995, 1234567.891, -1234.5, float("nan"), float("inf"), float("-inf"), None]


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(VALUES)), "c_custkey long, c_acctbal double")
    pq.write_table(rows.toArrow(), tmp_path / "customer.parquet")
    return str(tmp_path)


def test_awkward_balances(spark, folder):
    assert parity.differences(plans.queries()["currency_text"](spark, folder), parity.connect(folder), plans.oracles()["currency_text"]) == []


def test_reports_show_a_dash(spark):
    rows = spark.createDataFrame([(-0.0,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in rows.select(reports.currency(F.col("v"))).collect()] == ["USD 0.00", "-", "-"]
