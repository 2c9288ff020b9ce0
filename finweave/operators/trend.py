"""Piecewise-linear trends with penalised kinks, seasons and regressors.

A series meets its model through sums of products of its design columns, which
are added up over rows in any order; what is solved per key has a fixed size,
however long the series is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.functions.num import norm_ppf


@dataclass(frozen=True)
class Trend:
    """``kinks`` evenly over the first ``reach`` of the time, each with an L1
    penalty of noise variance over ``looseness`` (values in units of their
    greatest size, time from 0 to 1); ``harmonics`` pairs of sine and cosine of
    ``period`` (in units of the order column)."""

    kinks: int = 25
    reach: float = 0.8
    looseness: float = 0.05
    period: float = 0.0
    harmonics: int = 0
    regressors: tuple[str, ...] = ()

    @property
    def places(self) -> np.ndarray:
        return np.linspace(0, self.reach, self.kinks + 1)[1:]

    @property
    def free(self) -> int:
        """Columns without penalty: level, slope, season, regressors."""
        return 2 + 2 * self.harmonics + len(self.regressors)

    def design(self, at: np.ndarray, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Rows of the design at times ``at`` (0 to 1; ``t`` as in the data), kinks last."""
        turns = 2 * np.pi * np.outer(t / (self.period or 1), np.arange(1, self.harmonics + 1))
        return np.column_stack([np.ones(len(at)), at, np.sin(turns), np.cos(turns), x, np.maximum(at[:, None] - self.places, 0)])


def soft(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def lasso(gram: np.ndarray, right: np.ndarray, penalty: np.ndarray, start: np.ndarray | None = None, rounds: int = 20_000, exact: float = 1e-11) -> np.ndarray:
    """Least 1/2 b'Gb - r'b + penalty |b|_1 of each row of a batch, by cycles of
    coordinate descent: one coordinate of all rows at a time."""
    b = np.zeros_like(right) if start is None else start.copy()
    d = np.maximum(np.diagonal(gram, axis1=1, axis2=2), 1e-300)
    rest = right - (gram @ b[:, :, None])[:, :, 0]
    for _ in range(rounds):
        moved = 0.0
        for j in range(b.shape[1]):
            new = np.where(d[:, j] > 1e-12, soft(rest[:, j] + d[:, j] * b[:, j], penalty) / d[:, j], 0.0)
            step = new - b[:, j]
            if step.any():
                rest -= gram[:, :, j] * step[:, None]
                b[:, j] = new
                moved = max(moved, float((np.abs(step) * np.sqrt(d[:, j])).max()))
        if moved < exact:
            break
    return b


def solve(sums: np.ndarray, n: np.ndarray, model: Trend, rounds: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, noise variance and penalty of each key from the sums of
    products of (design, value). What has no penalty is taken out exactly; the
    penalty follows the noise that it leaves until both agree."""
    u, k = model.free, sums.shape[1] - 1
    g, r, yy = sums[:, :k, :k], sums[:, :k, k], sums[:, k, k]
    inverse = np.linalg.pinv(g[:, :u, :u], rcond=1e-12, hermitian=True)
    cross = inverse @ g[:, :u, u:]
    schur = g[:, u:, u:] - g[:, u:, :u] @ cross
    right = r[:, u:] - (g[:, u:, :u] @ inverse @ r[:, :u, None])[:, :, 0]
    left = np.maximum(yy - (r[:, None, :u] @ inverse @ r[:, :u, None])[:, 0, 0], 0)

    def noise(b: np.ndarray) -> np.ndarray:
        return np.maximum(left - 2 * (b * right).sum(1) + (b[:, None] @ schur @ b[:, :, None])[:, 0, 0], 0) / np.maximum(n, 1)

    b = (np.linalg.pinv(schur, rcond=1e-10, hermitian=True) @ right[:, :, None])[:, :, 0]
    sigma2 = noise(b)
    for _ in range(rounds):
        b = lasso(schur, right, sigma2 / model.looseness, b)
        last, sigma2 = sigma2, noise(b)
        if (np.abs(sigma2 - last) <= 1e-9 * (sigma2 + 1e-12)).all():
            break
    penalty = sigma2 / model.looseness
    b = lasso(schur, right, penalty, b)
    free = (inverse @ r[:, :u, None])[:, :, 0] - (cross @ b[:, :, None])[:, :, 0]
    return np.concatenate([free, b], 1), noise(b), penalty


FIT = "first double, last double, scale double, n long, coefficients array<double>, noise double, penalty double, at_last array<double>"


def fits(series: DataFrame, model: Trend = Trend(), key: str = "ticker", order: str = "t", value: str = "value") -> DataFrame:
    """A row a key: the time's first and last value, scale, n, coefficients
    (level, slope, sines, cosines, regressors, kinks' changes of slope; in units
    of scale and of the whole time), noise (variance, in scale squared), penalty
    and the regressors' last known values.

    ``order`` is a number. Rows without value, time or a regressor are left
    out; keys with fewer than two times or no value but 0 have level and slope
    alone to tell. A key of a third of all rows is many tasks: rows become sums
    where they lie.
    """
    names = list(model.regressors)
    rows = series.select(F.col(key).alias("k"), F.col(order).cast("double").alias("t"), F.col(value).cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in names]).cast("array<double>").alias("x"))
    known = F.col("t").isNotNull() & F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull())
    rows = rows.filter(known)
    bounds = rows.groupBy("k").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max(F.abs("y")).alias("scale"), F.count(F.lit(1)).alias("n"), F.max_by("x", F.struct("t", "y")).alias("at_last"))
    wide = model.free + model.kinks + 1
    kind = series.select(key).schema[0].dataType.simpleString()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["k"].dictionary_encode("encode")
            code = keys.indices.to_numpy(zero_copy_only=False)
            t, y, first, last, scale = (batch[c].to_numpy(zero_copy_only=False) for c in ("t", "y", "first", "last", "scale"))
            x = np.array(batch["x"].to_pylist(), float).reshape(len(t), len(names))
            z = np.column_stack([model.design((t - first) / np.where(last > first, last - first, 1), t, x), y / np.where(scale > 0, scale, 1)])
            some = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[some])) + 1
            parts = [p for p in np.split(some, cuts) if len(p)]
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array([code[p[0]] for p in parts])), pa.array([(z[p].T @ z[p]).reshape(-1) for p in parts], pa.list_(pa.float64()))], names=["k", "sums"])

    ends = bounds.select(F.col("k").alias("__k"), "first", "last", "scale")
    joined = rows.join(ends, F.col("k").eqNullSafe(F.col("__k"))).select("k", "t", "y", "x", "first", "last", "scale")
    sums = joined.mapInArrow(add_up, f"k {kind}, sums array<double>").select("k", F.posexplode("sums").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    sums = sums.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums"))
    ready = bounds.join(sums.withColumnRenamed("k", "__k"), F.col("k").eqNullSafe(F.col("__k"))).drop("__k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.array(batch["sums"].to_pylist(), float).reshape(-1, wide, wide)
                b, noise, penalty = solve(s, batch["n"].to_numpy(), model)
                yield pa.RecordBatch.from_arrays(
                    [batch["k"], batch["first"], batch["last"], batch["scale"], batch["n"], pa.array(list(b), pa.list_(pa.float64())), pa.array(noise), pa.array(penalty), batch["at_last"]],
                    names=[key, "first", "last", "scale", "n", "coefficients", "noise", "penalty", "at_last"],
                )

    return ready.mapInArrow(run, f"{key} {kind}, {FIT}")


def kinks(fitted: DataFrame, model: Trend = Trend(), key: str = "ticker", least: float = 1e-9) -> DataFrame:
    """key, at (time), change (of slope, a unit of time) of each kink that is not 0."""
    place = F.array(*[F.lit(float(p)) for p in model.places])
    each = fitted.select(key, "first", "last", "scale", F.posexplode(F.slice("coefficients", model.free + 1, model.kinks)).alias("i", "change"), place.alias("places"))
    span = F.col("last") - F.col("first")
    return each.filter(F.abs("change") > least).select(key, (F.col("first") + F.get("places", F.col("i")) * span).alias("at"), (F.col("change") * F.col("scale") / span).alias("change"))


def value_at(t: Column, x: Column, model: Trend) -> Column:
    """The model at a time with regressors ``x`` (array), as an expression over a fit's columns."""
    b = lambda i: F.get("coefficients", F.lit(i))
    span = F.col("last") - F.col("first")
    at = (t - F.col("first")) / F.when(span > 0, span).otherwise(1.0)
    out = b(0) + b(1) * at
    for h in range(model.harmonics):
        turn = t * (2 * np.pi * (h + 1) / (model.period or 1))
        out = out + b(2 + h) * F.sin(turn) + b(2 + model.harmonics + h) * F.cos(turn)
    for i in range(len(model.regressors)):
        out = out + b(2 + 2 * model.harmonics + i) * F.get(x, F.lit(i))
    for i, p in enumerate(model.places):
        out = out + b(model.free + i) * F.greatest(at - float(p), F.lit(0.0))
    return out * F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)


def forecasts(fitted: DataFrame, model: Trend = Trend(), steps: int = 4, step: float = 1.0, key: str = "ticker", confidence: float = 0.95) -> DataFrame:
    """key, step, t, forecast, lower and upper; regressors hold their last
    values. Bounds: the noise, and slopes that go on changing as often as there
    are kinks and as much as they did on average (double exponential changes)."""
    z = norm_ppf((1 + confidence) / 2)
    each = fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("t", F.col("last") + F.col("step") * step)
    span = F.col("last") - F.col("first")
    size = F.aggregate(F.slice("coefficients", model.free + 1, model.kinks), F.lit(0.0), lambda a, v: a + F.abs(v)) / max(1, model.kinks)
    per_step = F.lit(model.kinks / model.reach * step) / F.when(span > 0, span).otherwise(1.0)
    h = F.col("step").cast("double")
    squares = (h - 1) * h * (2 * h - 1) / 6 * F.pow(step / F.when(span > 0, span).otherwise(1.0), F.lit(2))
    spread = F.sqrt(F.col("noise") + F.least(per_step, F.lit(1.0)) * 2 * size * size * squares) * F.col("scale")
    f = value_at(F.col("t"), F.col("at_last"), model)
    return each.select(key, "step", "t", f.alias("forecast"), (f - z * spread).alias("lower"), (f + z * spread).alias("upper"))
