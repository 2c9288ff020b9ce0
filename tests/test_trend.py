"""Penalised trends against enumeration, conditions of the optimum and planted kinks."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from finweave.operators import trend
from finweave.operators.trend import Trend


def enumerated(g, r, penalty):
    """The best of all patterns of signs: exact."""
    best, at = 0.0, np.zeros(len(r))
    for signs in itertools.product((-1, 0, 1), repeat=len(r)):
        s = np.array(signs)
        on = np.flatnonzero(s)
        if len(on):
            b = np.zeros(len(r))
            b[on] = np.linalg.solve(g[np.ix_(on, on)], r[on] - penalty * s[on])
            if (np.sign(b[on]) == s[on]).all():
                v = 0.5 * b @ g @ b - r @ b + penalty * np.abs(b).sum()
                if v < best:
                    best, at = v, b
    return at


def test_descent_is_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 30, 5)) + rng.normal(size=(12, 30, 1))
    g, r = x.transpose(0, 2, 1) @ x, (x.transpose(0, 2, 1) @ rng.normal(size=(12, 30, 1)))[:, :, 0]
    penalty = rng.uniform(0.1, 6, 12)
    got = trend.lasso(g, r, penalty)
    assert all(np.allclose(got[i], enumerated(g[i], r[i], penalty[i]), atol=1e-8) for i in range(12))


@pytest.mark.parametrize("model", [Trend(kinks=5), Trend(kinks=6, period=7.0, harmonics=2, regressors=("x",))])
def test_fit_meets_the_conditions_of_the_optimum(model):
    rng = np.random.default_rng(2)
    t = np.arange(90.0)
    x = rng.normal(size=(90, len(model.regressors)))
    y = np.where(t < 40, t, 80 - t) / 40 + 0.1 * rng.normal(size=90) + x.sum(1) * 0.3
    z = np.column_stack([model.design(t / 89, t, x), y])
    b, noise, penalty = (v[0] for v in trend.solve((z.T @ z)[None], np.array([90]), model))
    rest = y - z[:, :-1] @ b
    pull = z[:, :-1].T @ rest
    assert np.isclose(noise, rest @ rest / 90) and np.isclose(penalty, noise / model.looseness, rtol=1e-4)
    kinks = b[model.free :]
    assert np.abs(pull[: model.free]).max() < 1e-7 and np.abs(pull[model.free :]).max() <= penalty * (1 + 1e-6)
    assert np.allclose(pull[model.free :][kinks != 0], penalty * np.sign(kinks[kinks != 0]), atol=1e-6)


def rows_of(seed=3, n=201):
    """Keys with planted kinks at 48, 96 (slopes 1, -2, 0.5), a straight line, and a wavy one with a regressor."""
    rng = np.random.default_rng(seed)
    out = []
    for t in range(n):
        x = float(rng.normal())
        bent = t - 3 * max(0, t - 48) + 2.5 * max(0, t - 96)
        out += [("bent", t, bent + rng.normal() * 0.5, x), ("line", t, 5 + 0.3 * t + rng.normal() * 0.5, x), ("wavy", t, 3 * np.sin(2 * np.pi * t / 10) + 4 * x + 0.1 * t + rng.normal() * 0.1, x)]
    return [(k, int(t), float(v), x) for k, t, v, x in out] + [("bent", None, 1.0, 1.0), ("bent", 7, None, 1.0), ("one", 3, 2.0, 1.0), ("none", 3, None, 1.0), ("zero", 1, 0.0, 1.0), ("zero", 2, 0.0, 2.0)]


SCHEMA = "ticker string, t int, value double, x double"


def test_planted_kinks(spark):
    fitted = trend.fits(spark.createDataFrame(rows_of(), SCHEMA).repartition(7)).cache()
    assert {r["ticker"] for r in fitted.collect()} == {"bent", "line", "wavy", "one", "zero"}
    change: dict = {}
    for k, at, c in trend.kinks(fitted).collect():
        change.setdefault(k, []).append((at, c))
    bent = change["bent"]
    near = lambda place: sum(c for at, c in bent if abs(at - place) <= 8.1)
    assert abs(near(48) + 3) < 0.2 and abs(near(96) - 2.5) < 0.2 and sum(abs(c) for at, c in bent if min(abs(at - 48), abs(at - 96)) > 8.1) < 0.3
    assert sum(abs(c) for _, c in change.get("line", [])) < 0.05
    ahead = {(r["ticker"], r["step"]): r for r in trend.forecasts(fitted).collect()}
    assert all(abs(ahead["bent", h]["forecast"] - (200 + h - 3 * (152 + h) + 2.5 * (104 + h))) < 3 and ahead["bent", h]["lower"] < ahead["bent", h]["forecast"] < ahead["bent", h]["upper"] for h in (1, 4))
    assert abs(ahead["one", 1]["forecast"] - 2) < 1e-6 and ahead["zero", 1]["forecast"] == 0


def test_seasons_and_held_regressors(spark):
    model = Trend(kinks=4, period=10.0, harmonics=1, regressors=("x",))
    rows = rows_of()
    fitted = trend.fits(spark.createDataFrame(rows, SCHEMA), model)
    last = next(x for k, t, v, x in rows if k == "wavy" and t == 200)
    for r in trend.forecasts(fitted.filter("ticker = 'wavy'"), model, steps=6).collect():
        assert abs(r["forecast"] - (3 * np.sin(2 * np.pi * r["t"] / 10) + 4 * last + 0.1 * r["t"])) < 0.3


def test_sums_over_rows_are_the_dense_fit(spark):
    model = Trend(kinks=5)
    rows = [r for r in rows_of() if r[0] == "bent" and r[1] is not None and r[2] is not None]
    t, y = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    scale = np.abs(y).max()
    z = np.column_stack([model.design(t / 200, t, np.zeros((len(t), 0))), y / scale])
    want = trend.solve((z.T @ z)[None], np.array([len(t)]), model)[0][0]
    got = trend.fits(spark.createDataFrame(rows, SCHEMA).repartition(9), model).first()
    assert np.allclose(got["coefficients"], want, atol=1e-7) and got["n"] == len(t)


def test_bounds_cover(spark):
    """Of straight lines with noise, next values lie within the bounds at about their rate."""
    rng = np.random.default_rng(5)
    rows = [(f"k{k}", t, float(2 + 0.1 * t + rng.normal()), 0.0) for k in range(150) for t in range(104)]
    seen = {(k, t): v for k, t, v, _ in rows}
    ahead = trend.forecasts(trend.fits(spark.createDataFrame([r for r in rows if r[1] < 100], SCHEMA))).collect()
    inside = np.mean([r["lower"] <= seen[r["ticker"], int(r["t"])] <= r["upper"] for r in ahead])
    assert 0.9 <= inside <= 0.99 and len(ahead) == 600


def test_query_over_whole_tables(spark):
    """Registered forecasts against a dense fit of each ticker, made apart."""
    from finweave.plans import models

    sf = "/root/testdata/sf0.001"
    model = models.TREND
    rows: dict = {}
    for r in models.trend_rows(spark, sf).collect():
        rows.setdefault(r["ticker"], []).append((r["t"], r["value"], r["x"]))
    want = {}
    for k, v in rows.items():
        t, y, x = np.array(sorted(v)).T
        at = (t - t.min()) / (t.max() - t.min())
        scale = np.abs(y).max()
        z = np.column_stack([model.design(at, t, x[:, None]), y / scale])
        b = trend.solve((z.T @ z)[None], np.array([len(t)]), model)[0][0]
        ahead = t.max() + np.arange(1, 5)
        want |= {(k, h + 1): v * scale for h, v in enumerate(model.design((ahead - t.min()) / (t.max() - t.min()), ahead, np.full((4, 1), x[-1])) @ b)}
    got = {(r["ticker"], r["step"]): r["forecast"] for r in models.trend_forecasts(spark, sf).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[i], want[i], rtol=1e-5) for i in got)
    places = models.trend_kinks(spark, sf).collect()
    assert all(abs(r["change"]) > 0 for r in places)
