"""Whole results of the factor, portfolio and forecast queries against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from finweave import plans
from finweave.plans import models

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    """Names, days in order and a matrix of returns; nulls are NaN."""
    rows = [r for r in models._panel(spark, SF).collect() if r["ret"] is not None]
    names, days = sorted({r["asset"] for r in rows}), sorted({r["date"] for r in rows})
    x = np.full((len(days), len(names)), np.nan)
    for r in rows:
        x[days.index(r["date"]), names.index(r["asset"])] = r["ret"]
    return names, days, x


@pytest.fixture(scope="module")
def cov(panel):
    _, _, x = panel
    out = np.empty((x.shape[1],) * 2)
    for i in range(len(out)):
        for j in range(len(out)):
            on = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            out[i, j] = np.cov(x[on, i], x[on, j])[0, 1]
    return out


def told(spark, name):
    return plans.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def loadings(cov):
    d = np.sqrt(np.diag(cov))
    val, vec = np.linalg.eigh(cov / np.outer(d, d))
    vec = vec[:, ::-1][:, :3]
    return val[::-1][:3], vec * np.sign(vec[np.abs(vec).argmax(0), range(3)])


def test_loadings(spark, panel, loadings):
    names, _, _ = panel
    got = {(r["asset"], r["factor"]): r for r in told(spark, "factor_loadings")}
    assert len(got) == 3 * len(names)
    for i, a in enumerate(names):
        for k in range(3):
            assert np.isclose(got[a, k + 1]["loading"], loadings[1][i, k], atol=1e-8) and np.isclose(got[a, k + 1]["eigenvalue"], loadings[0][k])


def test_scores_and_names(spark, panel, loadings):
    names, days, x = panel
    z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0, ddof=1)
    got = {(r["date"], r["factor"]): r["score"] for r in told(spark, "factor_scores")}
    want = np.nan_to_num(z) @ loadings[1]
    assert len(got) == 3 * len(days) and all(np.isclose(got[d, k + 1], want[i, k], atol=1e-7) for i, d in enumerate(days) for k in range(3))
    top = {k + 1: " / ".join(sorted(names, key=lambda a: (-abs(loadings[1][names.index(a), k]), a))[:3]) for k in range(3)}
    assert {r["factor"]: r["name"] for r in told(spark, "factor_names")} == top


def test_adequacy(spark, panel, cov):
    _, _, x = panel
    d = np.sqrt(np.diag(cov))
    c = cov / np.outer(d, d)
    inv = np.linalg.inv(c)
    partial = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(len(c), dtype=bool)
    r = told(spark, "factor_tests")[0]
    n = max(int((np.isfinite(x[:, i]) & np.isfinite(x[:, j])).sum()) for i in range(len(c)) for j in range(len(c)))
    assert np.isclose(r["kmo"], (c[off] ** 2).sum() / ((c[off] ** 2).sum() + (partial[off] ** 2).sum()))
    assert np.isclose(r["bartlett_chi2"], -(n - 1 - (2 * len(c) + 5) / 6) * np.log(np.linalg.det(c))) and 0 <= r["bartlett_p"] <= 1


def test_portfolios(spark, panel, cov):
    """Weights add up to 1, figures follow from them, and each method meets the conditions of its optimum."""
    names, _, x = panel
    k = len(names)
    s = (0.9 * cov + 0.1 * np.trace(cov) / k * np.eye(k)) * 252
    mu = np.nanmean(x, 0) * 252
    rows: dict = {}
    for r in told(spark, "portfolio_methods"):
        rows.setdefault(r["method"], {})[r["asset"]] = r
    assert len(rows) == 6
    for method, each in rows.items():
        w = np.array([each[a]["weight"] for a in names])
        risk = np.sqrt(w @ s @ w)
        assert abs(w.sum() - 1) < 1e-8 and w.min() > -1e-12
        assert all(np.isclose(each[a]["expected_risk"], risk) and np.isclose(each[a]["expected_return"], w @ mu) for a in names)
        assert np.allclose([each[a]["component_risk"] for a in names], w * (s @ w) / risk, atol=1e-9)
        pull = s @ w
        if method == "min_volatility":
            assert np.ptp(pull[w > 1e-6]) < 1e-5 * pull.max() and pull[w <= 1e-6].min(initial=np.inf) >= pull[w > 1e-6].min() - 1e-6
        if method == "risk_parity":
            assert np.ptp(w * pull) < 1e-6 * (w @ pull)


def test_forecasts_and_best_models(spark):
    """The trend of each ticker by least squares, its held-out error, and the choice of the least error."""
    series: dict = {}
    for r in models._series(spark, SF).orderBy("ticker", "fiscal_year").collect():
        if r["value"] is not None:
            series.setdefault(r["ticker"], []).append(r["value"])
    got: dict = {}
    for r in told(spark, "forecasts"):
        got.setdefault((r["ticker"], r["model"]), {})[r["step"]] = r
    for ticker, y in series.items():
        y = np.array(y)
        if len(y) < 3:
            assert (ticker, "trend") not in got
            continue
        k = np.polyfit(np.arange(len(y)), y, 1)
        cut = max(2, int(0.8 * len(y)))
        held = y[cut:] - np.polyval(np.polyfit(np.arange(cut), y[:cut], 1), np.arange(cut, len(y)))
        for h in range(4):
            r = got[ticker, "trend"][h + 1]
            assert np.isclose(r["forecast"], np.polyval(k, len(y) + h)) and np.isclose(r["rmse"], np.sqrt((held**2).mean()))
    best = {r["ticker"]: (r["best_model"], r["rmse"]) for r in told(spark, "best_models")}
    for ticker in {t for t, _ in got}:
        errors = {m: v[1]["rmse"] for (t, m), v in got.items() if t == ticker and v[1]["rmse"] is not None}
        assert np.isclose(best[ticker][1], min(errors.values())) and np.isclose(errors[best[ticker][0]], min(errors.values()))
