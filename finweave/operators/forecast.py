"""Forecasts of short series per key, features and model choice."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.functions.num import Series, div

S = Series()


def features(stmt: DataFrame, metrics: Sequence[str] = ("Revenue", "NetIncome", "OperatingIncome"), key: str = "ticker", order: str = "fiscal_year") -> DataFrame:
    """Growth, moving mean and spread, lags, margins, slope of the four points
    before, and calendar terms of each period."""
    s = Series((key,), (order,))
    cols = {}
    for m in metrics:
        cols |= {f"{m}_growth": s.change(m), f"{m}_ma3": s.mean(m, 3), f"{m}_std4": s.std(m, 4)}
        cols |= {f"{m}_lag{n}": s.lag(m, n) for n in (1, 2, 4)}
    before = s.w.rowsBetween(-4, -1)
    t = F.col(order).cast("double")
    first = metrics[0]
    cols |= {"trend": F.when(F.count(first).over(before) == 4, F.regr_slope(F.col(first), t).over(before)), "ordinal": F.row_number().over(s.w) - 1}
    return stmt.select(key, order, *metrics, *[e.alias(n) for n, e in cols.items()]).withColumn("ordinal_squared", F.col("ordinal") * F.col("ordinal"))


def filled(df: DataFrame, columns: Sequence[str], key: str = "ticker", order: str = "fiscal_year") -> DataFrame:
    """Gaps: one step forward, else between neighbours by position (two rows
    apart at most), else the key's median."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("__i", F.row_number().over(w))
    out = {}
    for c in columns:
        step = F.last(c, ignorenulls=True).over(w.rowsBetween(-1, 0))
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(c).alias("v")))
        a, b = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        line = F.when((b["i"] - a["i"] <= 3) & (F.col("__i") - a["i"] <= 2), a["v"] + (b["v"] - a["v"]) * (F.col("__i") - a["i"]) / (b["i"] - a["i"]))
        out[c] = F.coalesce(F.col(c), step, line, F.percentile(c, F.lit(0.5)).over(Window.partitionBy(key)))
    return d.withColumns(out).drop("__i")


def top_features(df: DataFrame, target: str, names: Sequence[str], n: int = 10) -> DataFrame:
    """Features by size of correlation with the target: one aggregate."""
    a = df.agg(*[F.corr(c, target).alias(c) for c in names])
    rows = a.unpivot([], list(names), "feature", "correlation").filter("correlation is not null and not isnan(correlation)")
    return rows.orderBy(F.abs("correlation").desc(), "feature").limit(n)


def holt_winters(y: np.ndarray, steps: int, period: int = 4, phi: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Additive, damped: fitted values and forecasts with the best of a grid of
    smoothing weights by squared error."""
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    seasonal = len(y) >= 2 * period
    for a in (0.2, 0.5, 0.8):
        for b in (0.05, 0.2):
            for g in (0.1, 0.3) if seasonal else (0.0,):
                level, trend = y[0], (y[min(len(y) - 1, 1)] - y[0])
                season = list(y[:period] - y[:period].mean()) if seasonal else [0.0] * period
                fit = np.zeros(len(y))
                for i, v in enumerate(y):
                    fit[i] = level + phi * trend + season[i % period]
                    new = a * (v - season[i % period]) + (1 - a) * (level + phi * trend)
                    trend = b * (new - level) + (1 - b) * phi * trend
                    season[i % period] = g * (v - new) + (1 - g) * season[i % period]
                    level = new
                ahead = np.array([level + trend * sum(phi**k for k in range(1, h + 2)) + season[(len(y) + h) % period] for h in range(steps)])
                sse = float(((y - fit) ** 2)[1:].sum())
                if best is None or sse < best[0]:
                    best = (sse, fit, ahead)
    return best[1], best[2]


def trend_fit(y: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(len(y) + steps)
    k = np.polyfit(x[: len(y)], y, 1) if len(y) > 1 else (0.0, y.mean())
    line = np.polyval(k, x)
    return line[: len(y)], line[len(y) :]


def ar_fit(y: np.ndarray, steps: int, p: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Autoregression by least squares, forecasts fed back."""
    if len(y) <= 2 * p + 1:
        return np.full(len(y), y.mean()), np.full(steps, y[-1])
    x = np.column_stack([np.ones(len(y) - p), *[y[p - k - 1 : len(y) - k - 1] for k in range(p)]])
    beta = np.linalg.lstsq(x, y[p:], rcond=None)[0]
    seen = list(y)
    for _ in range(steps):
        seen.append(float(beta[0] + sum(beta[k + 1] * seen[-k - 1] for k in range(p))))
    return np.concatenate([y[:p], x @ beta]), np.array(seen[len(y) :])


def seasonal_fit(y: np.ndarray, steps: int, period: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Trend plus one pair of Fourier terms of the period, by least squares."""
    t = np.arange(len(y) + steps)
    x = np.column_stack([np.ones(len(t)), t, np.sin(2 * np.pi * t / period), np.cos(2 * np.pi * t / period)])
    if len(y) <= x.shape[1]:
        return trend_fit(y, steps)
    line = x @ np.linalg.lstsq(x[: len(y)], y, rcond=None)[0]
    return line[: len(y)], line[len(y) :]


MODELS = {"trend": trend_fit, "seasonal": seasonal_fit, "autoregression": ar_fit, "holt_winters": holt_winters}


def forecasts(series: DataFrame, steps: int = 4, key: str = "ticker", order: str = "fiscal_year", value: str = "value") -> DataFrame:
    """Every model and their ensemble per key: forecast, bounds from the spread
    of held-out errors, and those errors' figures. The last fifth of a series
    is held out for choosing weights; forecasts use all of it. A key's series
    is short, so it is one grouped step."""
    kind = f"{key} string, model string, step int, forecast double, lower double, upper double, rmse double, mape double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].dropna().to_numpy(float)
        rows, ahead, weight = [], [], []
        name = pdf[key].iloc[0]
        if len(y) < 3:
            return pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])
        cut = max(2, math.floor(0.8 * len(y)))
        for model, fit in MODELS.items():
            err = y[cut:] - fit(y[:cut], len(y) - cut)[1]
            rmse = float(np.sqrt((err**2).mean())) if len(err) else 0.0
            mape = float(np.abs(err[y[cut:] != 0] / y[cut:][y[cut:] != 0]).mean() * 100) if (y[cut:] != 0).any() else None
            f = fit(y, steps)[1]
            ahead.append(f)
            weight.append(1 / (rmse + 1e-6))
            rows += [(name, model, h + 1, float(f[h]), float(f[h] - 1.96 * rmse), float(f[h] + 1.96 * rmse), rmse, mape) for h in range(steps)]
        w = np.array(weight) / sum(weight)
        e, spread = w @ np.array(ahead), float(w @ (1 / np.array(weight)))
        rows += [(name, "ensemble", h + 1, float(e[h]), float(e[h] - 1.96 * spread), float(e[h] + 1.96 * spread), None, None) for h in range(steps)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return series.select(key, order, value).groupBy(key).applyInPandas(run, kind)


#: Models from the simplest on; ``best_model`` takes the simpler of equal ones.
BY_SIZE = ("trend", "autoregression", "seasonal", "holt_winters", "ensemble")


def best_model(rows: DataFrame, key: str = "ticker", figure: str = "rmse") -> DataFrame:
    """The model of least error. Errors that differ by less than a billionth of
    the forecasts' size are equal (rounding decides nothing); then the simpler."""
    size = F.array_position(F.array(*[F.lit(m) for m in BY_SIZE]), F.col("model"))
    scaled = rows.filter(F.col(figure).isNotNull()).withColumn("__scale", F.max(F.abs("forecast")).over(Window.partitionBy(key)))
    rank = F.struct(F.round(F.col(figure) / F.when(F.col("__scale") > 0, F.col("__scale")).otherwise(1.0), 9), F.when(size == 0, len(BY_SIZE) + 1).otherwise(size), F.col("model"))
    best = scaled.groupBy(key).agg(F.min_by(F.struct("model", figure), rank).alias("b"))
    return best.select(key, F.col("b.model").alias("best_model"), F.col(f"b.{figure}").alias(figure))


def errors(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Figures of (actual, predicted): null or zero actuals are left out where they must."""
    a, p = F.col("actual"), F.col("predicted")
    m = pairs.filter("actual is not null and predicted is not null").groupBy(*keys).agg(F.avg(F.pow(a - p, F.lit(2))).alias("mse"), F.avg(F.abs(a - p)).alias("mae"), (F.avg(F.abs(div(a - p, a))) * 100).alias("mape"), F.var_pop("actual").alias("v"))
    return m.select(*keys, F.sqrt("mse").alias("rmse"), "mse", "mae", "mape", (1 - div("mse", "v")).alias("r2"))


def tree_model(df: DataFrame, names: Sequence[str], target: str, kind: str = "forest", share: float = 0.8, order: str = "fiscal_year") -> DataFrame:
    """Predictions of a forest or of boosted trees for the later part of the
    data, fitted on the earlier part: key columns, actual, predicted."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    data = df.na.drop(subset=[*names, target])
    v = VectorAssembler(inputCols=list(names), outputCol="__x").transform(data)
    at = data.agg(F.percentile(order, F.lit(share)).alias("q")).first()["q"]
    model = (RandomForestRegressor(featuresCol="__x", labelCol=target, numTrees=20, maxDepth=5, seed=42) if kind == "forest" else GBTRegressor(featuresCol="__x", labelCol=target, maxIter=10, seed=42)).fit(v.filter(F.col(order) <= at))
    return model.transform(v.filter(F.col(order) > at)).select("ticker", order, F.col(target).alias("actual"), F.col("prediction").alias("predicted"))
