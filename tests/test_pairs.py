"""Pair moments against numpy, likeness of findings against all pairs."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from finweave.operators import anomaly, pairs


@pytest.mark.parametrize("block", [512, 3])
def test_moments_of_pairs_that_share_days(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    g = np.random.default_rng(4)
    x = g.normal(size=(60, 8)) + 1e6 * np.arange(8)
    x[g.random(x.shape) < 0.2] = np.nan
    x[:, 6] = 5.0
    x[1:, 7] = np.nan
    x[0, 7] = 1.0
    rows = [(int(d), f"a{k}", None if np.isnan(v) else float(v)) for d, r in enumerate(x) for k, v in enumerate(r)] + [(None, "a1", 9.0), (3, None, 9.0)]
    df = spark.createDataFrame(rows, "date int, asset string, ret double").repartition(6)
    got = {(r["a"], r["b"]): r for r in pairs.with_covariance(pairs.pair_sums(df)).collect()}
    for i in range(8):
        for j in range(i, 8):
            on = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            r = got.pop((f"a{i}", f"a{j}"), None)
            if not on.any():
                assert r is None
                continue
            a, b = x[on, i], x[on, j]
            assert r["n"] == on.sum() and np.isclose(r["mean_a"], a.mean()) and np.isclose(r["mean_b"], b.mean())
            assert (r["covariance"] is None) == (on.sum() < 2) and (on.sum() < 2 or np.isclose(r["covariance"], np.cov(a, b)[0, 1], atol=1e-7))
            if on.sum() > 1 and a.std() > 0 and b.std() > 0:
                assert np.isclose(r["correlation"], np.corrcoef(a, b)[0, 1], atol=1e-7)
            else:
                assert r["correlation"] is None
    assert not got


def test_likeness_is_that_of_all_pairs(spark):
    g = random.Random(6)
    day = dt.date(2020, 1, 1)
    rows = [(t, m, day + dt.timedelta(d), g.choice([2.0, 2.25, 1.7, 2.2, 2.7, 1.6448536, round(g.uniform(1.6, 6), 2), g.uniform(1.6, 6)])) for t in "abc" for m in ("x", "y") for d in range(60)]
    rows += [("c", "z", day, 3.0), ("d", "z", day, 3.0), ("d", "z", day + dt.timedelta(1), 3.5), ("d", "z", day + dt.timedelta(2), 3.4999999)]
    got = {}
    for r in anomaly.similar(spark.createDataFrame(rows, "ticker string, metric string, date date, score double")).collect():
        got.setdefault((r["metric"], r["ticker"], r["date"]), []).append((r["place"], r["like_date"], r["like_ticker"], r["like_score"]))
    for t, m, d, s in rows:
        want = sorted((d2, t2, s2) for t2, m2, d2, s2 in rows if m2 == m and abs(s - s2) < 0.5 and (t2, d2) != (t, d))[:5]
        assert [x[1:] for x in sorted(got.get((m, t, d), []))] == want
