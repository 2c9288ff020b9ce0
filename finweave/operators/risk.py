"""Risk measures of return series (ticker, date, ret)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.functions import constants as K
from finweave.functions.num import Series, div, norm_ppf, norm_ppf_col
from finweave.operators import pairs

YEAR = 252
S = Series()


def drawdowns(returns: DataFrame) -> DataFrame:
    """Growth of 1, its running maximum and the fall from it; the peak starts
    at the first value."""
    r = returns.withColumn("growth", S.total(F.product, 1 + F.coalesce(F.col("ret"), F.lit(0.0))))
    r = r.withColumn("peak", S.total(F.max, "growth"))
    return r.withColumn("drawdown", div(F.col("growth") - F.col("peak"), "peak"))


def max_drawdown(returns: DataFrame) -> DataFrame:
    return drawdowns(returns).groupBy("ticker").agg((-F.min("drawdown")).alias("max_drawdown"))


def rolling_sharpe(returns: DataFrame, n: int = YEAR) -> DataFrame:
    return returns.withColumn("rolling_sharpe", div(S.mean("ret", n), S.std("ret", n)) * math.sqrt(YEAR))


def _level(confidence: float) -> float:
    return norm_ppf(1 - confidence)


def metrics(returns: DataFrame, confidences: Sequence[float] = (0.95, 0.99), risk_free: float = 0.03) -> DataFrame:
    """One row per ticker: value at risk (parametric, historical,
    Cornish-Fisher), expected shortfall, ratios and tail measures. Two passes:
    the moments, and what compares with them. Ratios without a denominator are null."""
    r = F.col("ret")
    base = returns.filter("ret is not null").groupBy("ticker").agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.stddev_pop(r).alias("sd0"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"), F.var_samp(r).alias("var"),
        F.percentile(r, F.array(*[F.lit(q) for q in (0.01, 0.05, 0.95)])).alias("q"),
    )
    cols: dict[str, Column] = {}
    for c in confidences:
        z, k = _level(c), round(c * 100)
        cols[f"var_{k}"] = -(F.col("mean") + F.col("sd0") * z)
        s, e = F.col("skew"), F.col("kurt")
        zc = z + (z**2 - 1) * s / 6 + (z**3 - 3 * z) * e / 24 - (2 * z**3 - 5 * z) * s * s / 36
        cols[f"cornish_fisher_var_{k}"] = -(F.col("mean") + F.col("sd0") * zc)
        cols[f"historical_var_{k}"] = -F.col("q")[1 if k == 95 else 0]
    base = base.withColumns(cols)
    j = returns.filter("ret is not null").join(base, "ticker")
    keep = [c for c in base.columns if c not in ("ticker", "q")]
    one = [F.first(c).alias(c) for c in keep] + [F.first("q").alias("q")]
    neg, pos = F.when(r < 0, r), F.when(r > 0, r)
    ex = r - risk_free / YEAR
    shortfall = [(-F.avg(F.when(r <= -F.col(f"var_{round(c * 100)}"), r))).alias(f"tail_{round(c * 100)}") for c in confidences]
    a = j.groupBy("ticker").agg(*one, *shortfall, F.avg(neg * neg).alias("neg2"), F.avg(pos).alias("up"), F.sum(pos).alias("gains"), (-F.sum(neg)).alias("losses"), F.avg(F.when(ex < 0, ex * ex)).alias("ex2"), F.avg((r < -F.col("var_95")).cast("double")).alias("breach"))
    a = a.join(max_drawdown(returns.filter("ret is not null")), "ticker")
    c = F.col
    n = c("n")
    g1 = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * c("skew"))
    g2 = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * c("kurt") + 6))
    root = math.sqrt(YEAR)
    return a.select(
        "ticker",
        "n",
        *[c(x) for x in cols],
        *[F.coalesce(c(f"tail_{round(x * 100)}"), c(f"var_{round(x * 100)}")).alias(f"cvar_{round(x * 100)}") for x in confidences],
        (c("sd") * root).alias("volatility"),
        F.coalesce(div(c("mean") - risk_free / YEAR, "sd") * root, F.lit(0.0)).alias("sharpe_ratio"),
        (div(c("mean") - risk_free / YEAR, F.sqrt("ex2")) * root).alias("sortino_ratio"),
        div(c("mean") * YEAR, "max_drawdown").alias("calmar_ratio"),
        "max_drawdown",
        F.coalesce(F.sqrt("neg2") * root, F.lit(0.0)).alias("downside_deviation"),
        div("up", F.sqrt("neg2")).alias("upside_potential"),
        div("gains", "losses").alias("omega_ratio"),
        F.abs(div(c("q")[2], c("q")[1])).alias("tail_ratio"),
        c("breach").alias("var_breach_probability"),
        F.coalesce(div("mean", "var") * 0.25, F.lit(0.0)).alias("kelly_fraction"),
        g1.alias("skewness"),
        g2.alias("excess_kurtosis"),
    )


def against(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Beta, alpha, tracking error and information ratio against a benchmark (date, bench)."""
    j = returns.join(benchmark, "date").filter("ret is not null and bench is not null").withColumn("active", F.col("ret") - F.col("bench"))
    a = j.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("ret", "bench").alias("cov"), F.var_samp("bench").alias("var"), F.avg("ret").alias("r"), F.avg("bench").alias("b"), F.avg("active").alias("act"), F.stddev_samp("active").alias("te"))
    beta = F.when(F.col("n") >= 2, F.coalesce(div("cov", "var"), F.lit(0.0)))
    root = math.sqrt(YEAR)
    return a.select("ticker", beta.alias("beta"), ((F.col("r") - beta * F.col("b")) * YEAR).alias("alpha"), (F.col("te") * root).alias("tracking_error"), (div("act", "te") * root).alias("information_ratio"))


def scenarios(spark) -> DataFrame:
    """The named stress scenarios with the mean of their factor shocks."""
    rows = [(n, float(sum(s.values()) / len(s)), p) for n, s, p in K.STRESS]
    return spark.createDataFrame(rows, "scenario string, shock double, probability double")


def stress(returns: DataFrame, cases: DataFrame) -> DataFrame:
    """Every scenario shifts all returns: value at risk at 99 percent and the
    expected loss over the sample."""
    m = returns.filter("ret is not null").groupBy("ticker").agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"), F.count("ret").alias("n"))
    j = m.crossJoin(F.broadcast(cases))
    mean = F.col("mean") + F.col("shock")
    return j.select("ticker", "scenario", "probability", (-(mean + F.col("sd") * _level(0.99))).alias("stressed_var_99"), (-mean * F.col("n")).alias("expected_loss"))


def correlations(wide_long: DataFrame) -> DataFrame:
    """Pairwise correlation and covariance of (date, asset, ret), each pair once."""
    return pairs.with_covariance(pairs.pair_sums(wide_long)).select("a", "b", "correlation", "covariance")


def gpd_fit(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of the generalised Pareto law by probability-weighted moments."""
    x = np.sort(excess)
    n = len(x)
    b0, b1 = x.mean(), (x * (n - 1 - np.arange(n)) / (n - 1)).sum() / n
    if b0 <= 2 * b1:
        return 0.0, float(b0)
    return float(2 - b0 / (b0 - 2 * b1)), float(2 * b0 * b1 / (b0 - 2 * b1))


def evt_var(x: np.ndarray, confidence: float) -> float:
    """Peaks over the 5 percent threshold; historical with fewer than ten."""
    x = x[~np.isnan(x)]
    if not len(x):
        return math.nan
    u = np.percentile(x, 5)
    peaks = u - x[x < u]
    if len(peaks) < 10:
        return float(-np.percentile(x, (1 - confidence) * 100))
    xi, beta = gpd_fit(peaks)
    odds = len(x) / len(peaks) * (1 - confidence)
    return float(-u + (beta / xi * (odds**-xi - 1) if abs(xi) > 1e-9 else -beta * math.log(odds)))


def garch_var(x: np.ndarray, confidence: float, horizon: int = 1) -> float:
    """GARCH(1,1) by quasi-likelihood on a grid of (alpha, beta) with the long-run variance fixed."""
    x = x[~np.isnan(x)]
    if len(x) < 20 or x.var() == 0:
        return math.nan
    e, v = x - x.mean(), x.var()
    best = (math.inf, 0.05, 0.9, v)
    for a in (0.02, 0.05, 0.1, 0.15, 0.2):
        for b in (0.6, 0.7, 0.8, 0.85, 0.9, 0.94):
            if a + b >= 0.999:
                continue
            h, ll = v, 0.0
            for s in e:
                ll += math.log(h) + s * s / h
                h = v * (1 - a - b) + a * s * s + b * h
            if ll < best[0]:
                best = (ll, a, b, h)
    _, a, b, h = best
    total = sum(v + (a + b) ** k * (h - v) for k in range(horizon))
    return float(-(x.mean() * horizon + math.sqrt(total) * _level(confidence)))


def model_vars(returns: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Extreme-value and GARCH value at risk: sequential fits per ticker."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")["ret"].to_numpy(float)
        return pd.DataFrame([(pdf["ticker"].iloc[0], evt_var(x, confidence), garch_var(x, confidence))], columns=["ticker", "evt_var", "garch_var"])

    return returns.select("ticker", "date", "ret").groupBy("ticker").applyInPandas(run, "ticker string, evt_var double, garch_var double")


def normal_draws(name: Column, n: int) -> Column:
    """n normal values, an array: quantiles of the first 8 digits of md5s of
    the name and a number, so they are the same in any partitioning."""
    u = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda d: (F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), d.cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32)
    return F.transform(u, norm_ppf_col)


def monte_carlo(returns: DataFrame, paths: int = 1000, days: int = 252, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Normal paths from each ticker's daily moments: mean, spread, loss
    chance, value at risk of the end value. A path is one row, its days are an
    array; draws follow from seed, ticker, path and day."""
    m = returns.filter("ret is not null").groupBy("ticker").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    sim = m.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(paths))))
    sim = sim.repartition("ticker", "path").withColumn("z", normal_draws(F.concat(F.lit(f"{seed}:"), F.col("ticker"), F.lit(":"), F.col("path").cast("string")), days))
    ends = sim.withColumn("total", F.aggregate("z", F.lit(1.0), lambda a, z: a * (1 + F.col("mean") + F.col("sd") * z)) - 1)
    t = F.col("total")
    return ends.groupBy("ticker").agg(
        F.count(t).alias("paths"), F.avg(t).alias("mean_return"), F.percentile(t, F.lit(0.5)).alias("median_return"), F.stddev_samp(t).alias("std_return"), F.avg((t < 0).cast("double")).alias("loss_probability"),
        (-F.percentile(t, F.lit(1 - confidence))).alias("var"), F.min(t).alias("worst"), F.max(t).alias("best"),
    )


def bootstrap(returns: DataFrame, samples: int = 200, block: int = 10, seed: int = 42) -> DataFrame:
    """Stationary bootstrap intervals of value at risk and Sharpe ratio."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")["ret"].dropna().to_numpy(float)
        g = np.random.default_rng(seed)
        n, got = len(x), []
        for _ in range(samples if n > 1 else 0):
            jump = g.random(n) < 1 / block
            jump[0] = True
            start = g.integers(n, size=n)
            at = np.where(jump, start, 0)
            last = np.maximum.accumulate(np.where(jump, np.arange(n), 0))
            y = x[(at[last] + np.arange(n) - last) % n]
            sd = y.std(ddof=1)
            got.append((-(y.mean() + y.std() * _level(0.95)), y.mean() / sd * math.sqrt(YEAR) if sd else 0.0))
        q = np.percentile(np.array(got), [2.5, 97.5], axis=0) if got else np.full((2, 2), np.nan)
        return pd.DataFrame([(pdf["ticker"].iloc[0], *q[:, 0], *q[:, 1])], columns=["ticker", "var_low", "var_high", "sharpe_low", "sharpe_high"])

    return returns.select("ticker", "date", "ret").groupBy("ticker").applyInPandas(run, "ticker string, var_low double, var_high double, sharpe_low double, sharpe_high double")


def copula_var(matrix: np.ndarray, confidence: float = 0.95, n: int = 10_000, seed: int = 42) -> float:
    """Gaussian copula of the ranks, normal margins, equal weights. ``matrix``
    is days by assets, pivoted from the long frame: k assets, small by nature."""
    x = matrix[~np.isnan(matrix).any(axis=1)]
    ranks = (x.argsort(0).argsort(0) + 1) / (len(x) + 1)
    z = np.vectorize(norm_ppf)(ranks)
    g = np.random.default_rng(seed)
    draw = g.standard_normal((n, x.shape[1])) @ np.linalg.cholesky(np.corrcoef(z.T) + 1e-9 * np.eye(x.shape[1])).T
    return float(-np.percentile((draw * x.std(0) + x.mean(0)).mean(1), (1 - confidence) * 100))
