"""Maximum-likelihood factor analysis by expectation and maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finweave.operators.factors import chi2_tail, correlation, moments, varimax

#: Least unique variance: a series that factors tell wholly has no likelihood.
LEAST = 1e-4


@dataclass
class Common:
    """k common factors of p series in units of their deviations: loadings (p,
    k), unique variances, log-likelihood a day after each step, days, and the
    test of k factors against any covariance."""

    assets: list[str]
    loadings: np.ndarray
    unique: np.ndarray
    path: list[float]
    days: int
    mean: np.ndarray
    deviation: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        return self.loadings @ self.loadings.T + np.diag(self.unique)

    def weights(self) -> np.ndarray:
        """Of a day's standardised values in the factors' expected values (k, p)."""
        k = self.loadings.shape[1]
        scaled = self.loadings / self.unique[:, None]
        return np.linalg.solve(np.eye(k) + self.loadings.T @ scaled, scaled.T)

    def test(self, s: np.ndarray) -> tuple[float, int, float]:
        """Likelihood ratio with Bartlett's correction, degrees of freedom, tail."""
        p, k = self.loadings.shape
        df = ((p - k) ** 2 - p - k) // 2
        x = max(0.0, (self.days - 1 - (2 * p + 5) / 6 - 2 * k / 3) * -2 * (log_likelihood(s, self.loadings, self.unique) - log_likelihood(s)))
        return x, df, chi2_tail(x, df) if df > 0 else 1.0


def log_likelihood(s: np.ndarray, loadings: np.ndarray | None = None, unique: np.ndarray | None = None) -> float:
    """Of a day's standardised values with second moments ``s``; without a
    model that of the moments themselves."""
    c = s if loadings is None else loadings @ loadings.T + np.diag(unique)
    return -0.5 * (len(s) * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + np.trace(np.linalg.solve(c, s)))


def step(s: np.ndarray, loadings: np.ndarray, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step: expected factors given the days, then loadings and unique
    variances given the factors. Days come in through their second moments."""
    k = loadings.shape[1]
    scaled = loadings / unique[:, None]
    beta = np.linalg.solve(np.eye(k) + loadings.T @ scaled, scaled.T)
    cross = s @ beta.T
    within = np.eye(k) - beta @ loadings + beta @ cross
    new = np.linalg.solve(within, cross.T).T
    return new, np.maximum(np.diag(s) - (new * cross).sum(1), LEAST)


def steps(s: np.ndarray, k: int, rounds: int = 5000, exact: float = 1e-12) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Loadings, unique variances and the log-likelihood before and after each
    step, from the principal components on, until a step gains nothing."""
    val, vec = np.linalg.eigh(s)
    loadings = vec[:, ::-1][:, :k] * np.sqrt(np.maximum(val[::-1][:k], 0))
    unique = np.maximum(np.diag(s) - (loadings**2).sum(1), 0.05)
    path = [log_likelihood(s, loadings, unique)]
    for _ in range(rounds):
        loadings, unique = step(s, loadings, unique)
        path.append(log_likelihood(s, loadings, unique))
        if path[-1] - path[-2] < exact:
            break
    return loadings, unique, path


def analyse(returns: DataFrame, k: int, rotate: bool = True) -> Common:
    """k common factors of (date, asset, ret).

    Days become second moments where they lie (each day's vector times
    itself), and k factors of p series are found from p * p numbers. Factors
    are turned by varimax, each with its greatest loading positive, in order
    of the variance they tell. Series without two different values are left out.
    """
    m = moments(returns)
    kept = np.flatnonzero(np.diag(m.cov) > 0)
    s = correlation(m.cov[np.ix_(kept, kept)])
    k = min(k, max(1, len(kept) - 1))
    loadings, unique, path = steps(s, k)
    if rotate and k > 1:
        loadings = varimax(loadings)
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    loadings = loadings[:, np.argsort(-(loadings**2).sum(0), kind="stable")]
    return Common([m.assets[i] for i in kept], loadings, unique, path, m.n, m.mean[kept], np.sqrt(np.diag(m.cov)[kept]))


def rows(spark, c: Common) -> DataFrame:
    """asset, factor, loading, communality and unique variance."""
    p, k = c.loadings.shape
    each = [(c.assets[i], j + 1, float(c.loadings[i, j]), float((c.loadings[i] ** 2).sum()), float(c.unique[i])) for i in range(p) for j in range(k)]
    return spark.createDataFrame(each, "asset string, factor int, loading double, communality double, unique double")


def scores(returns: DataFrame, c: Common) -> DataFrame:
    """date, factor and the factor's expected value given the day's returns;
    series that a day lacks are taken out of its model, not filled."""
    sent = returns.sparkSession.sparkContext.broadcast(c)
    days = returns.filter("ret is not null and date is not null").groupBy("date").agg(F.collect_list(F.struct(F.col("asset"), F.col("ret").cast("double").alias("ret"))).alias("day"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        at = {a: i for i, a in enumerate(m.assets)}
        k = m.loadings.shape[1]
        for batch in batches:
            out = []
            for day in batch["day"].to_pylist():
                z = {at[r["asset"]]: (r["ret"] - m.mean[at[r["asset"]]]) / m.deviation[at[r["asset"]]] for r in day if r["asset"] in at}
                on = sorted(z)
                load = m.loadings[on]
                scaled = load / m.unique[on][:, None]
                out.append(np.linalg.solve(np.eye(k) + load.T @ scaled, scaled.T @ np.array([z[i] for i in on])) if on else np.zeros(k))
            dates = batch["date"].take(pa.array(np.repeat(np.arange(batch.num_rows), k)))
            yield pa.RecordBatch.from_arrays([dates, pa.array(np.tile(np.arange(1, k + 1), batch.num_rows), pa.int32()), pa.array(np.concatenate([np.zeros(0), *out]))], names=["date", "factor", "score"])

    kind = returns.select("date").schema[0].dataType.simpleString()
    return days.mapInArrow(run, f"date {kind}, factor int, score double")
