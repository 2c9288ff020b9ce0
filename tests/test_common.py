"""Maximum-likelihood factors against an expectation step over the days themselves."""

from __future__ import annotations

import numpy as np
import pytest

from finweave.operators import common


def planted(seed=2, days=3000):
    g = np.random.default_rng(seed)
    load = np.array([[0.9, 0], [0.8, 0], [0.7, 0], [0, 0.85], [0, 0.75], [0, 0.6]])
    x = g.normal(size=(days, 2)) @ load.T + g.normal(size=(days, 6)) * np.sqrt(1 - (load**2).sum(1))
    return load, x


def over_days(x, k, rounds):
    """The plain algorithm: factors' law of each day, sums over days."""
    z = (x - x.mean(0)) / x.std(0, ddof=1) * np.sqrt(len(x) / (len(x) - 1))
    s = z.T @ z / len(z)
    val, vec = np.linalg.eigh(s)
    load = vec[:, ::-1][:, :k] * np.sqrt(np.maximum(val[::-1][:k], 0))
    unique = np.maximum(np.diag(s) - (load**2).sum(1), 0.05)
    for _ in range(rounds):
        inner = np.linalg.inv(np.eye(k) + load.T @ np.diag(1 / unique) @ load)
        means = z @ np.diag(1 / unique) @ load @ inner
        seconds = len(z) * inner + means.T @ means
        load = (z.T @ means) @ np.linalg.inv(seconds)
        unique = np.maximum((z**2).mean(0) - (load * (z.T @ means)).sum(1) / len(z), common.LEAST)
    return load, unique


def test_steps_are_those_over_days():
    _, x = planted(days=400)
    s = np.corrcoef(x.T)
    val, vec = np.linalg.eigh(s)
    load = vec[:, ::-1][:, :2] * np.sqrt(val[::-1][:2])
    unique = np.maximum(1 - (load**2).sum(1), 0.05)
    for _ in range(50):
        load, unique = common.step(s, load, unique)
    want = over_days(x, 2, 50)
    assert np.allclose(load, want[0], atol=1e-8) and np.allclose(unique, want[1], atol=1e-8)


@pytest.mark.parametrize("seed", range(5))
def test_likelihood_rises_to_an_optimum(seed):
    g = np.random.default_rng(seed)
    s = np.corrcoef(g.normal(size=(5, 40)) + g.normal(size=40))
    load, unique, path = common.steps(s, 2, exact=1e-14, rounds=40_000)
    assert all(b >= a - 1e-11 for a, b in zip(path, path[1:], strict=False))
    c = load @ load.T + np.diag(unique)
    pull = np.linalg.solve(c, np.linalg.solve(c, s - c).T)
    assert np.abs(pull @ load).max() < 1e-4
    free = unique > 0.01  # towards the least one steps get short
    assert np.abs(np.diag(pull)[free]).max() < 1e-4


def test_planted_loadings_and_scores(spark):
    load, x = planted()
    rows = [(d, f"a{k}", float(v)) for d, r in enumerate(x) for k, v in enumerate(r)]
    df = spark.createDataFrame([r for r in rows if r[:2] != (5, "a0")] + [(7, "flat", 1.0), (8, "flat", 1.0)], "date int, asset string, ret double").repartition(6)
    c = common.analyse(df, 2)
    assert c.assets == [f"a{k}" for k in range(6)] and np.abs(c.loadings - load).max() < 0.07
    assert c.test(np.corrcoef(x.T))[2] > 0.01 and c.test(np.corrcoef(x.T))[1] == 4
    assert common.analyse(df, 1).test(np.corrcoef(x.T))[2] < 1e-6
    told = {(r["date"], r["factor"]): r["score"] for r in common.scores(df, c).collect()}
    z = (x - c.mean) / c.deviation
    want = z @ c.weights().T
    days = [d for d in range(3000) if d != 5]
    assert len(told) == 6000 and np.allclose([[told[d, 1], told[d, 2]] for d in days], want[days], atol=1e-8)
    part = slice(1, 6)
    c2 = common.Common(c.assets[part], c.loadings[part], c.unique[part], [], 0, c.mean[part], c.deviation[part])
    assert np.allclose([told[5, 1], told[5, 2]], c2.weights() @ z[5, part])


def test_query_over_whole_tables(spark):
    from finweave.plans import models

    sf = "/root/testdata/sf0.001"
    days: dict = {}
    for r in models._panel(spark, sf).collect():
        if r["ret"] is not None:
            days.setdefault(r["asset"], {})[r["date"]] = r["ret"]
    names = sorted(days)
    s = np.eye(len(names))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = sorted(days[a].keys() & days[b].keys())
            s[i, j] = np.cov([days[a][d] for d in both], [days[b][d] for d in both])[0, 1]
    d = np.sqrt(np.diag(s))
    s = (s + s.T) / 2 / np.outer(d, d)
    load, unique, _ = common.steps(s, 2)
    got = {(r["asset"], r["factor"]): r for r in models.common_factors(spark, sf).collect()}
    assert len(got) == 2 * len(names)
    for i, a in enumerate(names):
        assert np.isclose(got[a, 1]["unique"], unique[i], atol=1e-4) and np.isclose(got[a, 1]["communality"], (load[i] ** 2).sum(), atol=1e-4)
