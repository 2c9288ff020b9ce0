"""Every query with a DuckDB statement gives its rows; the others run."""

from __future__ import annotations

import parity
import pytest

from finweave import plans

SF = "/root/testdata/sf0.001"
WITH_SQL = sorted(plans.oracles())
#: Whole results of these are compared with plain versions in tests of their own.
ELSEWHERE = set("arima_models arima_forecasts sarimax_forecasts trend_forecasts trend_kinks common_factors boosting_search recurrent_forecasts bottleneck_anomalies sentence_chunks paragraph_chunks key_entities token_chunks factor_loadings factor_scores factor_names factor_tests portfolio_methods forecasts best_models".split())
OTHERS = sorted(set(plans.queries()) - set(WITH_SQL) - ELSEWHERE)


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows(spark, con, name):
    assert parity.differences(plans.queries()[name](spark, SF), con, plans.oracles()[name]) == []


@pytest.mark.parametrize("name", OTHERS)
def test_runs(spark, name):
    df = plans.queries()[name](spark, SF)
    assert df.columns
    df.limit(5).collect()
