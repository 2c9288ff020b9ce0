"""State-space ARIMA against dense normal laws and planted parameters."""

from __future__ import annotations

import numpy as np
import pytest

from finweave.operators import arima
from finweave.operators.arima import Order


def autocovariances(ar, ma, n, terms=4000):
    psi = arima.weights(ar, ma, terms)
    return np.array([psi[: terms - k] @ psi[k:] for k in range(n)])


def toeplitz(c):
    return c[np.abs(np.subtract.outer(np.arange(len(c)), np.arange(len(c))))]


def simulated(seed, n, phi=(), theta=(), burn=200):
    e = np.random.default_rng(seed).normal(size=n + burn)
    y = np.zeros(n + burn)
    for t in range(max(len(phi), len(theta), 1), n + burn):
        y[t] = e[t] + sum(p * y[t - k - 1] for k, p in enumerate(phi)) + sum(q * e[t - k - 1] for k, q in enumerate(theta))
    return y[burn:]


@pytest.mark.parametrize("order", [Order(1, 0, 0), Order(0, 0, 2), Order(2, 0, 1), Order(1, 0, 1, 1, 0, 1), Order(0, 0, 0)])
def test_likelihood_is_that_of_the_dense_law(order):
    g = np.random.default_rng(3)
    u = g.normal(size=(3, order.size)) * 0.4
    y, x = g.normal(size=(3, 30)), g.normal(size=(3, 30, 2))
    seen = g.random((3, 30)) > 0.15
    got = arima.likelihood(u, order, np.concatenate([y[:, :, None], x], 2), seen)
    for i in range(3):
        ar, ma = (p[0] for p in arima.polynomials(u[i : i + 1], order))
        s = toeplitz(autocovariances(ar, ma, 30))[np.ix_(seen[i], seen[i])]
        inv, yy, xx = np.linalg.inv(s), y[i][seen[i]], x[i][seen[i]]
        beta = np.linalg.solve(xx.T @ inv @ xx, xx.T @ inv @ yy)
        e = yy - xx @ beta
        n = len(yy)
        sigma2 = e @ inv @ e / n
        assert np.allclose(got.beta[i], beta) and np.isclose(got.sigma2[i], sigma2)
        assert np.isclose(got.value[i], -0.5 * (n * np.log(2 * np.pi * sigma2) + np.linalg.slogdet(s)[1] + n))


def test_planted_parameters_are_found():
    many = [(simulated(k, 1500, (0.7,), (0.4,)), np.zeros((0, 1500))) for k in range(6)]
    found = np.array([f.parameters for f in arima.fit(many, Order(1, 0, 1))])
    assert np.abs(found.mean(0) - (0.7, 0.4)).max() < 0.03 and np.abs(found - (0.7, 0.4)).max() < 0.1


def test_no_trial_point_is_better():
    """The optimiser's value against a dense grid."""
    y = simulated(5, 60, (0.5,), (0.3,))
    best = arima.fit([(y, np.zeros((0, 60)))], Order(1, 0, 1))[0].log_likelihood
    axis = np.arctanh(np.linspace(-0.98, 0.98, 60))
    u = np.array([(a, b) for a in axis for b in axis])
    data, seen = arima.prepared([(y, np.zeros((0, 60)))], Order(1, 0, 1))
    assert best >= arima.likelihood(u, Order(1, 0, 1), np.repeat(data, len(u), 0), np.repeat(seen, len(u), 0)).value.max() - 1e-6


@pytest.mark.parametrize("order", [Order(1, 0, 1), Order(0, 1, 1), Order(1, 1, 0, 0, 1, 1), Order(2, 0, 0, 1, 0, 0)])
def test_forecasts_are_the_conditional_means(order):
    g = np.random.default_rng(8)
    x = g.normal(size=(1, 80)).cumsum(1)
    y = simulated(4, 80, (0.6,), (0.2,)).cumsum() * 3 + 2.5 * x[0] + 40
    f = arima.fit([(y, x)], order, 5)[0]
    u = arima.maximise(order, *scaled(y, x, order))
    ar, ma = (p[0] for p in arima.polynomials(u, order))
    w = arima.differenced(np.vstack([y, x]), order)
    beta = np.array(f.beta)
    e = w[0] - beta[0] * w[1] - (beta[1] if order.lost == 0 else 0)
    n = len(e)
    s = toeplitz(autocovariances(ar, ma, n + 5))
    ahead = s[n:, :n] @ np.linalg.solve(s[:n, :n], e)
    eta = list(y - beta[0] * x[0] - (beta[1] if order.lost == 0 else 0))
    c = arima.difference(order)
    for v in ahead:
        eta.append(v - sum(c[k] * eta[-k] for k in range(1, len(c))))
    want = np.array(eta[-5:]) + beta[0] * x[0, -1] + (beta[1] if order.lost == 0 else 0)
    assert np.allclose(f.forecast, want, rtol=1e-5)
    after = s[n:, n:] - s[n:, :n] @ np.linalg.solve(s[:n, :n], s[:n, n:])
    lift = np.array([[arima.weights(c, np.array([1.0]), 5)[i - j] if i >= j else 0 for j in range(5)] for i in range(5)])
    assert np.allclose(f.spread, np.sqrt(f.sigma2 * np.diag(lift @ after @ lift.T)), rtol=1e-4)


def scaled(y, x, order):
    data, seen = arima.prepared([(y, x)], order)
    wide = np.sqrt((data**2).mean(1))
    return data / wide[:, None], seen


def test_intervals_cover_at_their_rate():
    many = [simulated(k, 204, (0.6,), (0.3,)).cumsum() for k in range(200)]
    got = arima.fit([(y[:200], np.zeros((0, 200))) for y in many], Order(1, 1, 1), 4)
    inside = np.mean([abs(y[200 + h] - f.forecast[h]) <= 1.96 * f.spread[h] for y, f in zip(many, got, strict=True) for h in range(4)])
    assert 0.9 <= inside <= 0.985


def test_missing_values_and_short_series():
    y = simulated(1, 300, (0.8,))
    holes = y.copy()
    holes[50:250:7] = np.nan
    f, g, none, ends = arima.fit([(y, np.zeros((0, 300))), (holes, np.zeros((0, 300))), (y[:3], np.zeros((0, 3))), (np.append(y[:-1], np.nan), np.zeros((0, 300)))], Order(1, 0, 0), 2)
    assert none is None and ends is not None and abs(f.parameters[0] - g.parameters[0]) < 0.1
    assert arima.fit([(np.append(y[:-1], np.nan), np.zeros((0, 300)))], Order(0, 1, 0), 2) == [None]
    alone = arima.fit([(y[:40], np.zeros((0, 40)))], Order(1, 0, 0), 2)[0]
    beside = arima.fit([(y[:40], np.zeros((0, 40))), (y, np.zeros((0, 300)))], Order(1, 0, 0), 2)[0]
    assert np.allclose(alone.forecast, beside.forecast, atol=1e-6) and np.isclose(alone.aic, beside.aic, atol=1e-6)


def test_order_search_over_keys(spark):
    rows = [("ar", t, float(v), None) for t, v in enumerate(simulated(2, 400, (0.75, -0.5)))]
    rows += [("walk", t, float(v), None) for t, v in enumerate(simulated(3, 400).cumsum())]
    rows += [("ma", t, float(v), None) for t, v in enumerate(simulated(4, 400, (), (0.8,)))]
    df = spark.createDataFrame([*rows, ("short", 1, 2.0, None), ("null", 1, None, None)], "ticker string, date int, value double, x double")
    fitted = arima.fits(df, arima.grid())
    assert fitted.filter("ticker in ('short', 'null')").count() == 0 and fitted.groupBy("ticker").count().filter("count = 18").count() == 3
    best = {r["ticker"]: r["order"] for r in arima.chosen(fitted).collect()}
    assert (best["ar"]["p"], best["ar"]["d"]) == (2, 0) and best["walk"]["d"] == 1 and best["ma"]["d"] == 0 and best["ma"]["q"] >= 1
    out = arima.forecast_rows(arima.chosen(fitted))
    assert out.count() == 12 and out.filter("lower < forecast and forecast < upper").count() == 12


def test_regressor_and_planted_season(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=200)
    e = np.zeros(200)
    for t in range(200):
        e[t] = (0.8 * e[t - 4] if t > 3 else 0) + g.normal()
    df = spark.createDataFrame([("a", t, float(5 * x[t] + e[t]), float(x[t])) for t in range(200)], "ticker string, date int, value double, x double")
    best = arima.chosen(arima.fits(df, arima.grid(1, 1, 1, ((0, 0, 0), (1, 0, 0))), regressors=["x"])).first()
    assert best["order"]["sp"] == 1 and abs(best["beta"][0] - 5) < 0.3 and abs(best["parameters"][best["order"]["p"]] - 0.8) < 0.15


@pytest.mark.parametrize("name", ["arima", "sarimax"])
def test_queries_over_whole_tables(spark, name):
    """Each fit of each series and order against the dense law; the least AIC is chosen."""
    from finweave.plans import models

    sf = "/root/testdata/sf0.001"
    series = models.quarters(spark, sf)
    rows: dict = {}
    for r in series.orderBy("ticker", "date").collect():
        rows.setdefault(r["ticker"], []).append((r["value"], r["x"]))
    orders, names = (models.ARIMA_GRID, []) if name == "arima" else (models.SARIMAX_GRID, ["x"])
    fitted = arima.fits(series, orders, regressors=names).cache()
    least: dict = {}
    compared = 0
    for i, r in enumerate(fitted.orderBy("ticker", "order").collect()):
        o = Order(*r["order"])
        data = np.array(rows[r["ticker"]]).T[: 1 + len(names)]
        w = arima.differenced(data, o)
        x = np.vstack([w[1:], np.ones((int(o.lost == 0), w.shape[1]))])
        if (i % 5 == 0 or name == "sarimax") and np.abs(r["parameters"]).max(initial=0) < 0.95:  # beyond, the dense law takes too many terms
            ar, ma = plain_polynomials(r["parameters"], o)
            e = w[0] - np.array(r["beta"]) @ x if len(x) else w[0]
            s = toeplitz(autocovariances(ar, ma, len(e), 1500)) * r["sigma2"]
            dense = -0.5 * (len(e) * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + e @ np.linalg.solve(s, e))
            assert np.isclose(dense, r["log_likelihood"], rtol=1e-4)
            compared += 1
        assert np.isclose(r["aic"], 2 * (o.size + len(x) + 1) - 2 * r["log_likelihood"])
        k = (round(r["aic"], 6), o.size + o.d + o.D)
        least[r["ticker"]] = min(least.get(r["ticker"], (np.inf, 0)), k)
    assert compared > 10
    got = arima.chosen(fitted).collect()
    assert {r["ticker"] for r in got} == set(least) and all(np.isclose(r["aic"], least[r["ticker"]][0], atol=1e-5) for r in got)
    told = getattr(models, f"{name}_forecasts")(spark, sf).collect()
    assert len(told) == 4 * len(got)


def plain_polynomials(parameters, o):
    phi, sphi, theta, stheta = np.split(np.array(parameters), np.cumsum([o.p, o.P, o.q]))
    season = lambda c, sign: np.concatenate([[1.0], *[np.append(np.zeros(o.s - 1), sign * v) for v in c]])
    return np.polymul(np.append(1, -phi), season(sphi, -1)), np.polymul(np.append(1, theta), season(stheta, 1))
