"""Seasonal ARIMA with regressors by exact likelihood in state space.

The unit of work is a pair of series and order, so one series' orders are
spread over tasks; a task fits up to ``TOGETHER`` series of one order at once,
all of them and all trial points of the optimiser in one batched filter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.functions.num import norm_ppf

#: Series of one order that are fitted at once.
TOGETHER = 64
#: Fields of an order in Spark, where names don't differ by case.
PARTS = ("p", "d", "q", "sp", "sd", "sq", "season")
ORDER = "struct<" + ",".join(f"{n}:int" for n in PARTS) + ">"


@dataclass(frozen=True)
class Order:
    p: int
    d: int
    q: int
    P: int = 0
    D: int = 0
    Q: int = 0
    s: int = 4

    @property
    def size(self) -> int:
        return self.p + self.q + self.P + self.Q

    @property
    def lost(self) -> int:
        """Values that differencing takes."""
        return self.d + self.D * self.s


def grid(p: int = 2, d: int = 1, q: int = 2, seasonal: Sequence[tuple[int, int, int]] = ((0, 0, 0),), s: int = 4) -> list[Order]:
    return [Order(i, j, k, *x, s) for i in range(p + 1) for j in range(d + 1) for k in range(q + 1) for x in seasonal]


def stationary(u: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from any numbers: their
    hyperbolic tangents are its partial autocorrelations."""
    r = np.tanh(u) * 0.9999
    out = np.zeros_like(u)
    for k in range(u.shape[1]):
        head = out[:, :k]
        out[:, :k] = head - r[:, k, None] * head[:, ::-1]
        out[:, k] = r[:, k]
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials, a row each."""
    out = np.zeros((len(a), a.shape[1] + b.shape[1] - 1))
    for k in range(b.shape[1]):
        out[:, k : k + a.shape[1]] += a * b[:, k, None]
    return out


def polynomials(u: np.ndarray, o: Order) -> tuple[np.ndarray, np.ndarray]:
    """1 - phi B - ... and 1 + theta B + ..., seasonal factors taken in."""
    one = np.ones((len(u), 1))

    def of(x: np.ndarray, step: int, sign: float) -> np.ndarray:
        wide = np.zeros((len(x), x.shape[1] * step))
        wide[:, step - 1 :: step] = sign * stationary(x)
        return np.hstack([one, wide])

    a, b, c = o.p, o.p + o.P, o.p + o.P + o.q
    return product(of(u[:, :a], 1, -1), of(u[:, a:b], o.s, -1)), product(of(u[:, b:c], 1, -1), of(u[:, c:], o.s, -1))


def difference(o: Order) -> np.ndarray:
    """(1 - B)^d (1 - B^s)^D."""
    out = np.ones((1, 1))
    for _ in range(o.d):
        out = product(out, np.array([[1.0, -1.0]]))
    for _ in range(o.D):
        out = product(out, np.eye(1, o.s + 1) - np.eye(1, o.s + 1, o.s))
    return out[0]


def differenced(y: np.ndarray, o: Order) -> np.ndarray:
    """Along the last axis; null where a value is missing."""
    c = difference(o)
    n = y.shape[-1] - len(c) + 1
    return sum(w * y[..., len(c) - 1 - k : len(c) - 1 - k + n] for k, w in enumerate(c))


@dataclass
class Filtered:
    """Innovations (batch, time, data), their variances over sigma squared, and
    the law of the state after the last step; missing times have variance 1,
    innovation 0."""

    innovations: np.ndarray
    variances: np.ndarray
    state: np.ndarray
    covariance: np.ndarray
    companion: np.ndarray
    noise: np.ndarray


def kalman(ar: np.ndarray, ma: np.ndarray, data: np.ndarray, seen: np.ndarray) -> Filtered:
    """The filter of ARMA processes that start in their stationary law. All
    data (time, data) of a batch row pass one filter, as gains don't depend on
    them. ``seen``: which times are observed; others are predicted over."""
    n, r = len(ar), max(ar.shape[1] - 1, ma.shape[1])
    t = np.zeros((n, r, r))
    t[:, : ar.shape[1] - 1, 0] = -ar[:, 1:]
    t[:, np.arange(r - 1), np.arange(1, r)] = 1
    c = np.zeros((n, r))
    c[:, : ma.shape[1]] = ma
    noise = c[:, :, None] * c[:, None, :]
    p, a = noise.copy(), t
    for _ in range(30):  # doubling: sums of 2 ** k terms
        more = a @ p @ a.transpose(0, 2, 1)
        p = p + more
        if np.abs(more).max(initial=0) <= 1e-13 * np.abs(p).max(initial=1):
            break
        a = a @ a
    state = np.zeros((n, r, data.shape[2]))
    v, f = np.zeros(data.shape), np.ones(data.shape[:2])
    tt = t.transpose(0, 2, 1)
    steady = False
    for i in range(data.shape[1]):
        on = seen[:, i]
        if steady and on.all():  # the gain moves no more
            f[:, i] = p[:, 0, 0]
            v[:, i] = data[:, i] - state[:, 0]
            state = t @ (state + gain[:, :, None] * v[:, i, None, :])
            continue
        f[:, i] = np.where(on, p[:, 0, 0], 1.0)
        v[:, i] = np.where(on[:, None], data[:, i] - state[:, 0], 0.0)
        gain = np.where(on[:, None], p[:, :, 0] / f[:, i, None], 0.0)
        state = t @ (state + gain[:, :, None] * v[:, i, None, :])
        last, p = p, t @ (p - gain[:, :, None] * (gain * f[:, i, None])[:, None, :]) @ tt + noise
        steady = on.all() and bool(np.abs(p - last).max() <= 1e-14 * np.abs(p).max())
    return Filtered(v, f, state, p, t, noise)


@dataclass
class Likelihood:
    value: np.ndarray
    sigma2: np.ndarray
    beta: np.ndarray
    filtered: Filtered


def likelihood(u: np.ndarray, o: Order, data: np.ndarray, seen: np.ndarray) -> Likelihood:
    """Log-likelihoods at the best variance and regression coefficients: the
    first column of data on the others, by least squares of innovations."""
    got = kalman(*polynomials(u, o), data, seen)
    z = got.innovations / np.sqrt(got.variances)[:, :, None]
    x, y = z[:, :, 1:], z[:, :, 0]
    beta = np.zeros((len(u), x.shape[2]))
    if x.shape[2]:
        xx, xy = x.transpose(0, 2, 1) @ x, (x.transpose(0, 2, 1) @ y[:, :, None])
        beta = (np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ xy)[:, :, 0]
    rest = y - (x @ beta[:, :, None])[:, :, 0]
    n = seen.sum(1)
    sigma2 = np.maximum((rest**2).sum(1) / np.maximum(n, 1), 1e-300)
    value = -0.5 * (n * (np.log(2 * np.pi * sigma2) + 1) + np.log(got.variances).sum(1))
    return Likelihood(np.where(np.isfinite(value), value, -1e300), sigma2, beta, got)


def maximise(o: Order, data: np.ndarray, seen: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Unbounded parameters of the greatest likelihood of each row: BFGS from
    three starts, all rows, gradients' points and steps in one batch."""
    b, k = len(data), o.size
    if not k:
        return np.zeros((b, 0))
    is_ar = np.arange(k) < o.p + o.P
    starts = np.stack([np.full(k, 0.1), np.where(is_ar, 0.7, -0.2), np.where(is_ar, -0.3, 0.4)])
    u = np.repeat(starts, b, 0)
    rows = np.tile(np.arange(b), len(starts))

    def value(points: np.ndarray, of: np.ndarray) -> np.ndarray:
        return -likelihood(points, o, data[of], seen[of]).value

    def gradient(points: np.ndarray, of: np.ndarray) -> np.ndarray:
        e = 1e-5 * np.eye(k)
        both = np.concatenate([points[:, None] + e, points[:, None] - e], 1).reshape(-1, k)
        f = value(both, np.repeat(of, 2 * k)).reshape(len(points), 2, k)
        return (f[:, 0] - f[:, 1]) / 2e-5

    now, g = value(u, rows), gradient(u, rows)
    h = np.repeat(np.eye(k)[None], len(u), 0) * 0.1
    sizes = np.array([1.0, 0.5, 0.2, 0.05, 0.005])
    live = np.arange(len(u))
    for _ in range(rounds):
        step = -(h[live] @ g[live, :, None])[:, :, 0]
        uphill = (step * g[live]).sum(1) >= 0
        step[uphill] = -0.1 * g[live][uphill]
        step *= np.minimum(1, 3 / np.maximum(np.abs(step).max(1), 1e-300))[:, None]
        tried = np.clip(u[live, None] + sizes[None, :, None] * step[:, None], -12, 12)
        f = value(tried.reshape(-1, k), np.repeat(rows[live], len(sizes))).reshape(len(live), -1)
        pick = f.argmin(1)
        gained = now[live] - f[np.arange(len(live)), pick]
        moved = gained > 1e-9
        live, tried, f, pick, gained = live[moved], tried[moved], f[moved], pick[moved], gained[moved]
        if not len(live):
            break
        s = tried[np.arange(len(live)), pick] - u[live]
        u[live] += s
        now[live] = f[np.arange(len(live)), pick]
        new = gradient(u[live], rows[live])
        y = new - g[live]
        g[live] = new
        sy = (s * y).sum(1)
        for i in np.flatnonzero(sy > 1e-12):
            j, rho = live[i], 1 / sy[i]
            m = np.eye(k) - rho * np.outer(s[i], y[i])
            h[j] = m @ h[j] @ m.T + rho * np.outer(s[i], s[i])
        live = live[(gained > 1e-7) | (np.abs(new).max(1) > 1e-4)]
        if not len(live):
            break
    best = now.reshape(len(starts), b).argmin(0)
    return u.reshape(len(starts), b, k)[best, np.arange(b)]


@dataclass
class Fit:
    """Of one series: parameters phi, PHI, theta, THETA; coefficients of the
    regressors (the constant last, if nothing is differenced)."""

    parameters: list[float]
    beta: list[float]
    sigma2: float
    log_likelihood: float
    aic: float
    rmse: float
    forecast: list[float]
    spread: list[float]


def prepared(series: Sequence[tuple[np.ndarray, np.ndarray]], o: Order) -> tuple[np.ndarray, np.ndarray]:
    """Differenced data (series, time, 1 + regressors) with the constant, in
    equal lengths, and which of them are seen. Rows without all of them aren't."""
    length = max(len(y) for y, _ in series) - o.lost
    k = series[0][1].shape[0] + (o.lost == 0)
    data, seen = np.zeros((len(series), length, 1 + k)), np.zeros((len(series), length), bool)
    for i, (y, x) in enumerate(series):
        all_ = differenced(np.vstack([y, x]), o)
        if o.lost == 0:
            all_ = np.vstack([all_, np.ones(all_.shape[1])])
        ok = np.isfinite(all_).all(0)
        data[i, : len(ok)] = np.where(ok, all_, 0).T
        seen[i, : len(ok)] = ok
    return data, seen


def fit(series: Sequence[tuple[np.ndarray, np.ndarray]], o: Order, steps: int = 0) -> list[Fit | None]:
    """Fits of series (values; regressors, a row each) with one order, and
    their forecasts, regressors held at their last known values. None: fewer
    values than twice the parameters, or the last ones, which differences go
    on from, are unknown."""
    out: list[Fit | None] = [None] * len(series)
    few = lambda y, x: np.isfinite(differenced(np.vstack([y, x]), o)).all(0).sum() if len(y) > o.lost else 0
    fine = [i for i, (y, x) in enumerate(series) if few(y, x) >= max(4, 2 * (o.size + len(x) + (o.lost == 0) + 1)) and np.isfinite(np.vstack([y, x])[:, len(y) - o.lost :]).all()]
    if not fine:
        return out
    chosen = [series[i] for i in fine]
    data, seen = prepared(chosen, o)
    scale = np.sqrt(np.maximum((data[:, :, 0] ** 2).sum(1) / np.maximum(seen.sum(1), 1), 1e-300))
    data[:, :, 0] /= scale[:, None]
    wide = np.sqrt(np.maximum((data**2).sum(1) / np.maximum(seen.sum(1), 1)[:, None], 1e-300))
    wide[:, 0] = 1
    data /= wide[:, None]
    u = maximise(o, data, seen)
    got = likelihood(u, o, data, seen)
    ar, ma = polynomials(u, o)
    parts = np.split(u, np.cumsum([o.p, o.P, o.q]), axis=1)
    parameters = np.hstack([s * stationary(x) for x, s in zip(parts, (1, 1, -1, -1), strict=True)])
    n = seen.sum(1)
    beta = got.beta / wide[:, 1:]
    value = got.value - n * np.log(scale)
    innovations = got.filtered.innovations[:, :, 0] - (got.filtered.innovations[:, :, 1:] @ got.beta[:, :, None])[:, :, 0]
    rmse = np.sqrt((innovations**2).sum(1) / n) * scale
    aic = 2 * (o.size + beta.shape[1] + 1) - 2 * value
    for j, i in enumerate(fine):
        y, x = chosen[j]
        b = np.append(1.0, -got.beta[j])
        ahead = []
        # rows after a shorter series are not seen: the filter has predicted over them, so its last own state is made again
        own = kalman(ar[j : j + 1], ma[j : j + 1], data[j : j + 1, : len(y) - o.lost], seen[j : j + 1, : len(y) - o.lost])
        state = own.state[0] @ b
        for _ in range(steps):
            ahead.append(state[0] * scale[j])
            state = own.companion[0] @ state
        ahead = integrated(y, x, np.array(ahead), beta[j] * scale[j], o)
        spread = np.sqrt(got.sigma2[j] * ahead_variances(own, o, steps)) * scale[j]
        out[i] = Fit(parameters[j].tolist(), (beta[j] * scale[j]).tolist(), float(got.sigma2[j] * scale[j] ** 2), float(value[j]), float(aic[j]), float(rmse[j]), ahead.tolist(), spread.tolist())
    return out


def integrated(y: np.ndarray, x: np.ndarray, ahead: np.ndarray, beta: np.ndarray, o: Order) -> np.ndarray:
    """Forecasts of the series from those of its differences' disturbance."""
    known = beta[: len(x)]
    last = np.array([r[np.isfinite(r)][-1] if np.isfinite(r).any() else 0.0 for r in x])
    level = float(known @ last) + (beta[-1] if o.lost == 0 else 0.0)
    past = list((y - known @ x)[len(y) - o.lost :]) if o.lost else []
    c = difference(o)
    for h, w in enumerate(ahead):
        past.append(w - sum(c[k] * past[o.lost + h - k] for k in range(1, len(c))))
    return np.array(past[o.lost :]) + level


def ahead_variances(filtered: Filtered, o: Order, steps: int) -> np.ndarray:
    """Of the errors of the next steps of the series, over sigma squared: the
    state's law is carried on, and differences are added up."""
    t, p, noise = filtered.companion[0], filtered.covariance[0], filtered.noise[0]
    cov = np.zeros((steps, steps))
    for i in range(steps):
        row = p[:, 0]
        for j in range(i, steps):  # with what is still to come after step i
            cov[i, j] = cov[j, i] = row[0]
            row = t @ row
        p = t @ p @ t.T + noise
    up = weights(difference(o), np.ones(1), steps)
    lift = np.array([[up[i - j] if i >= j else 0.0 for j in range(steps)] for i in range(steps)]).reshape(steps, steps)
    return np.diag(lift @ cov @ lift.T)


def weights(ar: np.ndarray, ma: np.ndarray, steps: int) -> np.ndarray:
    """Weights of past shocks: the moving average that an ARIMA process is."""
    psi = np.zeros(steps)
    for j in range(steps):
        psi[j] = (ma[j] if j < len(ma) else 0.0) - sum(ar[k] * psi[j - k] for k in range(1, min(j, len(ar) - 1) + 1))
    return psi


FITTED = f"order {ORDER}, parameters array<double>, beta array<double>, sigma2 double, log_likelihood double, aic double, rmse double, forecast array<double>, spread array<double>"


def fits(series: DataFrame, orders: Sequence[Order], steps: int = 4, key: str = "ticker", order: str = "date", value: str = "value", regressors: Sequence[str] = ()) -> DataFrame:
    """Every order fitted to every series: key, order, parameters (phi, PHI,
    theta, THETA), beta, sigma2, log_likelihood, aic, rmse of one-step errors,
    forecast and spread (standard deviation) of the next ``steps``.

    ``series`` has a row a time; times must be evenly spaced, a null value is
    missing and predicted over. A series is one row of arrays: some ten
    thousand times a key are meant. Series too short for an order, or without
    the last values that it goes on from, have no row for it.
    """
    rows = series.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value, *regressors))).alias("rows"))
    rows = rows.select(key, F.col("rows").getField(value).cast("array<double>").alias("y"), F.array(*[F.col("rows").getField(c).cast("array<double>") for c in regressors]).cast("array<array<double>>").alias("x"))
    pairs = rows.withColumn("order", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(PARTS, astuple(o), strict=True)]) for o in orders])))
    spark = series.sparkSession
    groups = max(1, series.select(key).distinct().count() // TOGETHER)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(orders) * groups, 4 * spark.sparkContext.defaultParallelism))
    dealt = pairs.repartition(tasks, "order", F.pmod(F.xxhash64(key), F.lit(groups))).sortWithinPartitions("order")
    names = [x.split()[0] for x in FITTED.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def made() -> pa.RecordBatch:
            o = Order(*waiting[0][1].values())
            got = [(w[0], w[1], f) for w, f in zip(waiting, fit([(w[2], w[3]) for w in waiting], o, steps), strict=True) if f is not None]
            waiting.clear()
            columns = [pa.array([k for k, _, _ in got], kind), pa.array([x for _, x, _ in got], pa.struct([(n, pa.int32()) for n in PARTS]))]
            columns += [pa.array([getattr(f, n) for _, _, f in got], pa.list_(pa.float64()) if n in ("parameters", "beta", "forecast", "spread") else pa.float64()) for n in names]
            return pa.RecordBatch.from_arrays(columns, names=[key, "order", *names])

        for batch in batches:
            kind = batch[key].type
            for k, o, y, x in zip(batch[key].to_pylist(), batch["order"].to_pylist(), batch["y"].to_pylist(), batch["x"].to_pylist(), strict=True):
                if waiting and (waiting[0][1] != o or len(waiting) >= TOGETHER):
                    yield made()
                waiting.append((k, o, np.array(y, float), np.array(x, float).reshape(len(x), len(y))))
        if waiting:
            yield made()

    kind_of_key = series.select(key).schema[0].dataType.simpleString()
    return dealt.mapInArrow(run, f"{key} {kind_of_key}, {FITTED}")


def size_of(order: Column) -> Column:
    return sum((order[n] for n in PARTS[1:-1]), order["p"])


def chosen(fitted: DataFrame, key: str = "ticker") -> DataFrame:
    """The fit of least AIC of each series; of equal ones (six digits) that
    with fewer parameters, then the first order."""
    rank = F.struct(F.round("aic", 6), size_of(F.col("order")), F.col("order"))
    best = fitted.groupBy(key).agg(F.min_by(F.struct(*[c for c in fitted.columns if c != key]), rank).alias("b"), F.count(F.lit(1)).alias("tried"))
    return best.select(key, "b.*", "tried")


def forecast_rows(best: DataFrame, key: str = "ticker", confidence: float = 0.95) -> DataFrame:
    """key, step, forecast, lower and upper."""
    z = norm_ppf((1 + confidence) / 2)
    each = best.select(key, F.posexplode(F.arrays_zip("forecast", "spread")).alias("i", "f"))
    return each.select(key, (F.col("i") + 1).alias("step"), F.col("f.forecast").alias("forecast"), (F.col("f.forecast") - z * F.col("f.spread")).alias("lower"), (F.col("f.forecast") + z * F.col("f.spread")).alias("upper"))
