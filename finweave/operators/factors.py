"""Factor models and portfolios: moments in Spark, k x k algebra in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.functions.num import div
from finweave.operators import pairs


@dataclass
class Moments:
    assets: list[str]
    mean: np.ndarray
    cov: np.ndarray
    n: int


def moments(returns: DataFrame) -> Moments:
    """Mean, covariance and days of (date, asset, ret) over days that all pairs
    share pairwise; k assets, so k * k numbers come to the driver."""
    c = pairs.with_covariance(pairs.pair_sums(returns)).select("a", "b", "covariance", "mean_a", "n").collect()
    assets = sorted({r["a"] for r in c})
    at = {x: i for i, x in enumerate(assets)}
    cov, mean = np.zeros((len(assets), len(assets))), np.zeros(len(assets))
    for r in c:
        i, j = at[r["a"]], at[r["b"]]
        cov[i, j] = cov[j, i] = r["covariance"] or 0.0
        if i == j:
            mean[i] = r["mean_a"]
    return Moments(assets, mean, cov, max((r["n"] for r in c), default=0))


def correlation(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1))
    return cov / np.outer(sd, sd)


def varimax(loadings: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Orthogonal rotation to the greatest spread of squared loadings."""
    k = loadings.shape[1]
    r, last = np.eye(k), 0.0
    for _ in range(rounds):
        x = loadings @ r
        u, s, v = np.linalg.svd(loadings.T @ (x**3 - x * (x**2).mean(0)))
        r = u @ v
        if s.sum() < last * (1 + 1e-8):
            break
        last = s.sum()
    return loadings @ r


def loadings(m: Moments, k: int = 5, rotate: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the correlation matrix and the loadings of the first k
    components, each with its greatest entry positive."""
    val, vec = np.linalg.eigh(correlation(m.cov))
    order = np.argsort(-val)[:k]
    out = vec[:, order]
    out = varimax(out) if rotate else out
    return val[order], out * np.sign(out[np.abs(out).argmax(0), np.arange(out.shape[1])])


def loading_rows(spark, m: Moments, k: int = 5) -> DataFrame:
    val, load = loadings(m, min(k, len(m.assets)))
    rows = [(m.assets[i], j + 1, float(load[i, j]), float(val[j]), float(val[j] / len(m.assets))) for i in range(len(m.assets)) for j in range(load.shape[1])]
    return spark.createDataFrame(rows, "asset string, factor int, loading double, eigenvalue double, variance_explained double")


def scores(returns: DataFrame, load: DataFrame) -> DataFrame:
    """Factor scores of each day: standardised returns times loadings."""
    s = returns.filter("ret is not null").groupBy("asset").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"))
    z = returns.filter("ret is not null").join(s, "asset").select("date", "asset", div(F.col("ret") - F.col("m"), "sd").alias("z"))
    return z.join(load, "asset").groupBy("date", "factor").agg(F.sum(F.col("z") * F.col("loading")).alias("score"))


def factor_names(load: DataFrame) -> DataFrame:
    """Each factor by the assets of its three greatest loadings."""
    w = Window.partitionBy("factor").orderBy(F.abs("loading").desc(), "asset")
    top = load.withColumn("place", F.row_number().over(w)).filter("place <= 3")
    return top.groupBy("factor").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "asset"))), lambda x: x["asset"]), " / ").alias("name"))


def alpha_signals(score_rows: DataFrame, lookback: int = 20) -> DataFrame:
    """Momentum (rolling mean against the sample's 30 and 70 percent
    quantiles) and reversal (last value beyond two deviations) of each factor."""
    w = Window.partitionBy("factor").orderBy("date")
    frame = w.rowsBetween(-(lookback - 1), 0)
    s = score_rows.withColumn("roll", F.when(F.count("score").over(frame) == lookback, F.avg("score").over(frame)))
    a = s.groupBy("factor").agg(F.max_by("roll", "date").alias("momentum"), F.percentile("roll", F.array(F.lit(0.3), F.lit(0.7))).alias("q"), F.max_by("score", "date").alias("last"), F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"))
    z = div(F.col("last") - F.col("m"), "sd")
    return a.select("factor", "momentum", F.col("q")[1].alias("entry"), F.col("q")[0].alias("exit"), z.alias("zscore"), F.when(F.abs(z) > 2, -0.1 * z).alias("reversal_return"))


def kmo(corr: np.ndarray) -> float:
    """Sampling adequacy: squared correlations against squared partial ones."""
    try:
        inv = np.linalg.inv(corr)
    except np.linalg.LinAlgError:
        return 0.5
    d = np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(len(corr), dtype=bool)
    r, p = (corr[off] ** 2).sum(), ((-inv / d)[off] ** 2).sum()
    return float(r / (r + p)) if r + p else 0.5


def chi2_tail(x: float, df: float) -> float:
    """P(chi-square > x): the regularised upper incomplete gamma function, by
    its series or its continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-14:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def bartlett(corr: np.ndarray, n: int) -> tuple[float, float]:
    p = len(corr)
    sign, logdet = np.linalg.slogdet(corr)
    if sign <= 0:
        return math.inf, 0.0
    x = -(n - 1 - (2 * p + 5) / 6) * logdet
    return float(x), float(chi2_tail(x, p * (p - 1) / 2))


# Portfolios ------------------------------------------------------------------

YEAR = 252


def on_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest weights that are not negative and add up to 1."""
    u = np.sort(v)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - c[np.flatnonzero(u > c)[-1]], 0)


def shrunk(cov: np.ndarray, share: float = 0.1) -> np.ndarray:
    """Covariance drawn to a multiple of the identity."""
    return (1 - share) * cov + share * np.trace(cov) / len(cov) * np.eye(len(cov))


def _descend(gradient, k: int, step: float, rounds: int = 4000) -> np.ndarray:
    w = np.full(k, 1 / k)
    for _ in range(rounds):
        w = on_simplex(w - step * gradient(w))
    return w


def min_volatility(s: np.ndarray) -> np.ndarray:
    return _descend(lambda w: s @ w, len(s), 1 / np.linalg.norm(s, 2))


def efficient(mu: np.ndarray, s: np.ndarray, taste: float) -> np.ndarray:
    """Greatest return less taste / 2 times variance, long only."""
    return _descend(lambda w: taste * (s @ w) - mu, len(s), 1 / (taste * np.linalg.norm(s, 2)))


def frontier(mu: np.ndarray, s: np.ndarray, points: int = 25) -> list[tuple[float, float, np.ndarray]]:
    out = []
    for taste in np.geomspace(0.1, 1000, points):
        w = efficient(mu, s, taste)
        out.append((float(w @ mu), float(math.sqrt(w @ s @ w)), w))
    return out


def max_sharpe(mu: np.ndarray, s: np.ndarray, risk_free: float = 0.02) -> np.ndarray:
    """The frontier's point of greatest excess return over risk."""
    return max(frontier(mu, s, 60), key=lambda p: (p[0] - risk_free) / p[1] if p[1] else -math.inf)[2]


def risk_parity(s: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Equal contributions to risk, by cyclical coordinate descent."""
    k = len(s)
    w = 1 / np.sqrt(np.diag(s))
    for _ in range(rounds):
        for i in range(k):
            b = s[i] @ w - s[i, i] * w[i]
            w[i] = (-b + math.sqrt(b * b + 4 * s[i, i] / k)) / (2 * s[i, i])
    return w / w.sum()


def hierarchical(s: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: single linkage of correlation distances, then
    bisection by inverse variance."""
    d = np.sqrt(np.maximum(0, (1 - correlation(s)) / 2))
    groups = [[i] for i in range(len(s))]
    while len(groups) > 1:
        pairs = [(min(d[i, j] for i in a for j in b), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
        _, x, y = min(pairs)
        groups[x] = groups[x] + groups.pop(y)
    w = np.ones(len(s))

    def variance(part: list[int]) -> float:
        v = 1 / np.diag(s)[part]
        v = v / v.sum()
        return float(v @ s[np.ix_(part, part)] @ v)

    todo = [groups[0]]
    while todo:
        part = todo.pop()
        if len(part) > 1:
            a, b = part[: len(part) // 2], part[len(part) // 2 :]
            share = 1 - variance(a) / (variance(a) + variance(b))
            w[a] *= share
            w[b] *= 1 - share
            todo += [a, b]
    return w


def black_litterman(s: np.ndarray, taste: float = 2.5) -> np.ndarray:
    """Weights of the equilibrium returns of an equal-weighted market."""
    k = len(s)
    return efficient(taste * s @ np.full(k, 1 / k), s, taste)


def contributions(w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal and component risk; the components add up to the risk."""
    risk = math.sqrt(w @ s @ w)
    return s @ w / risk, w * (s @ w) / risk


METHODS = {
    "max_sharpe": lambda mu, s: max_sharpe(mu, s),
    "min_volatility": lambda mu, s: min_volatility(s),
    "risk_parity": lambda mu, s: risk_parity(s),
    "hierarchical_risk_parity": lambda mu, s: hierarchical(s),
    "black_litterman": lambda mu, s: black_litterman(s),
    "robust": lambda mu, s: efficient(mu - np.sqrt(np.diag(s)) * 0.1, s, 5.0),
}


def portfolios(spark, m: Moments, risk_free: float = 0.02) -> DataFrame:
    """Weights, risk contributions and figures of every method."""
    mu, s = m.mean * YEAR, shrunk(m.cov) * YEAR
    rows = []
    for name, f in METHODS.items():
        w = f(mu, s)
        marginal, part = contributions(w, s)
        ret, risk = float(w @ mu), float(math.sqrt(w @ s @ w))
        rows += [(name, a, float(w[i]), float(marginal[i]), float(part[i]), ret, risk, (ret - risk_free) / risk) for i, a in enumerate(m.assets)]
    return spark.createDataFrame(rows, "method string, asset string, weight double, marginal_risk double, component_risk double, expected_return double, expected_risk double, sharpe_ratio double")


def allocation(weights: dict[str, float], prices: dict[str, float], value: float) -> tuple[dict[str, int], float]:
    """Whole shares: rounded down, then one share at a time to the asset
    furthest below its weight while money lasts."""
    n = {a: int(w * value // prices[a]) for a, w in weights.items()}
    cash = value - sum(n[a] * prices[a] for a in n)
    while affordable := [a for a in n if prices[a] <= cash and weights[a] > 0]:
        a = max(affordable, key=lambda x: weights[x] - n[x] * prices[x] / value)
        if weights[a] * value - n[a] * prices[a] <= 0:
            break
        n[a] += 1
        cash -= prices[a]
    return n, cash


def efficient_for(mu: np.ndarray, s: np.ndarray, value: float, by: str = "return") -> np.ndarray:
    """The frontier's weights with a stated return or risk, by bisection on the
    taste for risk; its ends where the value is beyond them."""
    lo, hi = 1e-2, 1e4
    for _ in range(40):
        mid = math.sqrt(lo * hi)
        w = efficient(mu, s, mid)
        got = float(w @ mu) if by == "return" else math.sqrt(w @ s @ w)
        lo, hi = (mid, hi) if got > value else (lo, mid)
    return efficient(mu, s, math.sqrt(lo * hi))


def common_factors(corr: np.ndarray, k: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Loadings and unique variances of k common factors: principal axes of the
    correlation matrix with communalities on its diagonal, repeated, then varimax."""
    inv = np.linalg.pinv(corr)
    common = np.clip(1 - 1 / np.diag(inv), 0.01, 1)
    load = np.zeros((len(corr), k))
    for _ in range(rounds):
        r = corr.copy()
        np.fill_diagonal(r, common)
        val, vec = np.linalg.eigh(r)
        at = np.argsort(-val)[:k]
        load = vec[:, at] * np.sqrt(np.maximum(val[at], 0))
        new = np.clip((load**2).sum(1), 0, 1)
        if np.abs(new - common).max() < 1e-8:
            break
        common = new
    load = varimax(load) if k > 1 else load
    return load, 1 - (load**2).sum(1)


def independent(x: np.ndarray, k: int, rounds: int = 300, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Independent components of days x assets: whitened, then the fixed point
    of the tanh contrast, all components together. Returns sources and mixing."""
    x = x - x.mean(0)
    u, d, v = np.linalg.svd(x, full_matrices=False)
    z = u[:, :k] * math.sqrt(len(x))
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        g = np.tanh(z @ w.T)
        a, _, b = np.linalg.svd(g.T @ z / len(z) - np.diag((1 - g**2).mean(0)) @ w)
        new = a @ b
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-9
        w = new
        if done:
            break
    return z @ w.T, (w @ (np.diag(d[:k]) @ v[:k]) / math.sqrt(len(x))).T


def risk_decomposition(target: DataFrame, factors_: DataFrame) -> DataFrame:
    """Share of a series' variance (date, ret) by factor (date, factor, value):
    squared slope of a joint regression times the factor's variance, and the
    rest. Moments are made in Spark; k + 1 of them squared come to the driver."""
    both = target.select("date", F.lit("").alias("factor"), F.col("ret").alias("value")).unionByName(factors_.select("date", "factor", "value"))
    m = moments(both.withColumnsRenamed({"factor": "asset", "value": "ret"}))
    y, names = m.assets.index(""), [i for i, a in enumerate(m.assets) if a]
    beta = np.linalg.lstsq(m.cov[np.ix_(names, names)], m.cov[names, y], rcond=None)[0]
    total = m.cov[y, y]
    share = beta**2 * np.diag(m.cov)[names] / total if total else np.zeros(len(names))
    rows = [(m.assets[i], float(b), float(s)) for i, b, s in zip(names, beta, share, strict=True)]
    return target.sparkSession.createDataFrame([*rows, ("residual", None, float(1 - share.sum()))], "factor string, beta double, variance_share double")


def panel_signals(score_rows: DataFrame, returns: DataFrame, load: DataFrame, lookback: int = 20) -> DataFrame:
    """Signals across assets: the last rolling mean of the mean residual, and
    the last spread of factor scores where it is beyond 1.5 times its mean."""
    s = returns.filter("ret is not null").groupBy("asset").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"))
    z = returns.filter("ret is not null").join(s, "asset").select("date", "asset", div(F.col("ret") - F.col("m"), "sd").alias("z"))
    fit = score_rows.join(load.select("asset", "factor", "loading"), "factor").groupBy("date", "asset").agg(F.sum(F.col("score") * F.col("loading")).alias("fit"))
    daily = z.join(fit, ["date", "asset"]).groupBy("date").agg(F.avg(F.col("z") - F.col("fit")).alias("residual"))
    w = Window.orderBy("date").rowsBetween(-(lookback - 1), 0)
    rolled = daily.withColumn("value", F.when(F.count("residual").over(w) == lookback, F.avg("residual").over(w)))
    momentum = rolled.agg(F.max_by("value", "date").alias("value")).select(F.lit("residual_momentum").alias("signal_name"), "value", F.lit(True).alias("emitted"))
    spread = score_rows.groupBy("date").agg(F.stddev_samp("score").alias("d")).agg(F.max_by("d", "date").alias("value"), F.avg("d").alias("m"))
    return momentum.unionByName(spread.select(F.lit("cross_sectional").alias("signal_name"), "value", (F.col("value") > 1.5 * F.col("m")).alias("emitted")))
