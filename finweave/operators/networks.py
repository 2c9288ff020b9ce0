"""Recurrent forecasters and a bottleneck detector, trained on all rows.

Each epoch is a pass: tasks make the gradients of their rows, sums of these
meet in the shuffle, one step is taken, and the next pass carries the new
parameters. Results don't depend on how rows lie in partitions (but for
rounding), and a lost executor costs a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.functions.num import div
from finweave.operators.training import Adam, summed


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _parts(theta: np.ndarray, shapes: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [p.reshape(s) for p, s in zip(np.split(theta, ends[:-1]), shapes, strict=True)]


@dataclass(frozen=True)
class Recurrent:
    """Layers of ``lstm`` or ``gru`` cells over a window of values; the last
    state, with ``dropout``, gives the next value."""

    cell: str = "lstm"
    hidden: int = 8
    layers: int = 1
    length: int = 12
    dropout: float = 0.0

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        n, gates = self.hidden, 4 if self.cell == "lstm" else 3
        each = [[(1 if k == 0 else n, gates * n), (n, gates * n), (gates * n,)] for k in range(self.layers)]
        return [s for layer in each for s in layer] + [(n,), (1,)]

    @property
    def width(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes)

    def begin(self, seed: int = 1) -> np.ndarray:
        g = np.random.default_rng(seed)
        return np.concatenate([(g.normal(size=s) / np.sqrt(s[0]) if len(s) == 2 else g.normal(size=s) * 0.1 if s == (self.hidden,) else np.zeros(s)).reshape(-1) for s in self.shapes])

    def _forward(self, theta: np.ndarray, x: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, tuple]:
        p, n = _parts(theta, self.shapes), self.hidden
        inputs, caches = x[:, :, None], []
        for k in range(self.layers):
            wx, wh, b = p[3 * k : 3 * k + 3]
            h = c = np.zeros((len(x), n))
            out, steps = [], []
            for t in range(inputs.shape[1]):
                before, cell_before = h, c
                a = inputs[:, t] @ wx + b
                if self.cell == "lstm":
                    a = a + h @ wh
                    i, f, o, g = sigmoid(a[:, :n]), sigmoid(a[:, n : 2 * n] + 1), sigmoid(a[:, 2 * n : 3 * n]), np.tanh(a[:, 3 * n :])
                    c = f * c + i * g
                    h = o * np.tanh(c)
                    steps.append((before, cell_before, i, f, o, g, c))
                else:
                    r, z = sigmoid(a[:, :n] + h @ wh[:, :n]), sigmoid(a[:, n : 2 * n] + h @ wh[:, n : 2 * n])
                    u = h @ wh[:, 2 * n :]
                    g = np.tanh(a[:, 2 * n :] + r * u)
                    h = (1 - z) * g + z * h
                    steps.append((before, r, z, u, g))
                out.append(h)
            caches.append((inputs, steps))
            inputs = np.stack(out, 1)
        last = inputs[:, -1] if keep is None else inputs[:, -1] * keep
        return last @ p[-2] + p[-1], (p, caches, last, inputs)

    def predict(self, theta: np.ndarray, x: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        return self._forward(theta, x, keep)[0]

    def gradient(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray, keep: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Sum of half squared errors, and what it changes by with theta."""
        told, (p, caches, last, top) = self._forward(theta, x, keep)
        n, e = self.hidden, told - y
        grads = [np.zeros(s) for s in self.shapes]
        grads[-2], grads[-1] = e @ last, np.array([e.sum()])
        down = np.zeros_like(top)
        down[:, -1] = e[:, None] * p[-2] * (1 if keep is None else keep)
        for k in range(self.layers - 1, -1, -1):
            inputs, steps = caches[k]
            wx, wh, _ = p[3 * k : 3 * k + 3]
            below = np.zeros_like(inputs)
            dh, dc = np.zeros((len(x), n)), np.zeros((len(x), n))
            for t in range(len(steps) - 1, -1, -1):
                dh = dh + down[:, t]
                if self.cell == "lstm":
                    before, cell_before, i, f, o, g, c = steps[t]
                    th = np.tanh(c)
                    dc = dc + dh * o * (1 - th**2)
                    da = np.hstack([dc * g * i * (1 - i), dc * cell_before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g**2)])
                    grads[3 * k + 1] += before.T @ da
                    dc, dh = dc * f, da @ wh.T
                else:
                    before, r, z, u, g = steps[t]
                    dg = dh * (1 - z) * (1 - g**2)
                    dz, dr, du = dh * (before - g) * z * (1 - z), dg * u * r * (1 - r), dg * r
                    grads[3 * k + 1] += np.hstack([before.T @ dr, before.T @ dz, before.T @ du])
                    dh = dh * z + dr @ wh[:, :n].T + dz @ wh[:, n : 2 * n].T + du @ wh[:, 2 * n :].T
                    da = np.hstack([dr, dz, dg])
                grads[3 * k] += inputs[:, t].T @ da
                grads[3 * k + 2] += da.sum(0)
                below[:, t] = da @ wx.T
            down = below
        return float(0.5 * (e**2).sum()), np.concatenate([g.reshape(-1) for g in grads])


@dataclass(frozen=True)
class Bottleneck:
    """Fully connected layers of hyperbolic tangents, the last one linear, that
    tell a row of values from few numbers."""

    sizes: tuple[int, ...]

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        return [s for a, b in zip(self.sizes, self.sizes[1:], strict=False) for s in ((a, b), (b,))]

    @property
    def width(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes)

    def begin(self, seed: int = 1) -> np.ndarray:
        g = np.random.default_rng(seed)
        return np.concatenate([(g.normal(size=s) / np.sqrt(s[0]) if len(s) == 2 else np.zeros(s)).reshape(-1) for s in self.shapes])

    def _forward(self, theta: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        p, out = _parts(theta, self.shapes), [x]
        for k in range(0, len(p), 2):
            a = out[-1] @ p[k] + p[k + 1]
            out.append(np.tanh(a) if k + 2 < len(p) else a)
        return out

    def errors(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        return ((self._forward(theta, x)[-1] - x) ** 2).mean(1)

    def gradient(self, theta: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        p, out = _parts(theta, self.shapes), self._forward(theta, x)
        d = (out[-1] - x) / x.shape[1]
        loss, grads = float(0.5 * ((out[-1] - x) ** 2).mean(1).sum()), []
        for k in range(len(p) - 2, -1, -2):
            grads = [(out[k // 2].T @ d).reshape(-1), d.sum(0), *grads]
            if k:
                d = (d @ p[k].T) * (1 - out[k // 2] ** 2)
        return loss, np.concatenate(grads)


@dataclass
class Trained:
    theta: np.ndarray
    losses: list[float]


STATE = "epoch int, theta array<double>, m array<double>, v array<double>, losses array<double>"


def _saved(spark: SparkSession, folder: str):
    """The state of the last epoch that was written whole."""
    try:
        rows = spark.read.schema(STATE).parquet(folder).orderBy(F.desc("epoch")).limit(1).collect()
    except AnalysisException:  # nothing there yet
        return None
    return rows[0] if rows else None


def train(rows: DataFrame, of: Callable[[np.ndarray, int, pa.RecordBatch], tuple[float, np.ndarray]], theta: np.ndarray, epochs: int, rate: float = 0.02, folder: str | None = None, every: int = 10) -> Trained:
    """``epochs`` steps along the mean gradient of all rows; ``of`` makes the
    sums of a batch from the parameters and the epoch. With a ``folder`` (on
    storage that outlives the driver) the state is written every so many
    epochs, and a call goes on from what it finds there."""
    spark, width = rows.sparkSession, len(theta)
    adam, losses, first = Adam(width, rate), [], 0
    if folder and (at := _saved(spark, folder)):
        theta, adam.m, adam.v = (np.array(at[c]) for c in ("theta", "m", "v"))
        losses, first = list(at["losses"]), at["epoch"]
        adam.k = first
    for epoch in range(first, epochs):

        def made(batch: pa.RecordBatch, theta=theta, epoch=epoch) -> np.ndarray:
            loss, gradient = of(theta, epoch, batch)
            return np.concatenate([gradient, [loss, batch.num_rows]])

        got = summed(rows, made, width + 2)
        n = max(1.0, got[-1])
        losses.append(float(got[-2] / n))
        theta = adam.step(theta, got[:width] / n)
        if folder and ((epoch + 1) % every == 0 or epoch + 1 == epochs):
            row = [(epoch + 1, theta.tolist(), adam.m.tolist(), adam.v.tolist(), losses)]
            spark.createDataFrame(row, STATE).coalesce(1).write.mode("append").parquet(folder)
    return Trained(theta, losses)


def windows(series: DataFrame, length: int, key: str = "ticker", order: str = "date", value: str = "value") -> DataFrame:
    """key, order, x (the last ``length`` values), y (the next one, null for
    the last) of every row with a full window, in units of the key's deviation
    about its mean (columns m, s), and a hash h. Null values are left out
    before; keys of one value have none."""
    d = series.select(key, order, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    own = Window.partitionBy(key)
    d = d.withColumns({"m": F.avg("v").over(own), "s": F.stddev_samp("v").over(own)}).withColumn("z", div(F.col("v") - F.col("m"), "s")).filter("z is not null")
    w = Window.partitionBy(key).orderBy(order)
    d = d.withColumns({"x": F.collect_list("z").over(w.rowsBetween(1 - length, 0)), "y": F.lead("z").over(w)}).filter(F.size("x") == length)
    return d.select(key, order, "x", "y", "m", "s", F.xxhash64(key, order).alias("h"))


def kept_units(h: np.ndarray, dropout: float, width: int, draw: int) -> np.ndarray | None:
    """Which units of each row stay, scaled, by the row's hash and the draw."""
    if not dropout:
        return None
    units = (np.arange(width, dtype=np.uint64) + np.uint64(draw * width + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (h.astype(np.uint64)[:, None] ^ units) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((x >> np.uint64(11)).astype(float) / 2**53 >= dropout) / (1 - dropout)


def _windows_of(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy().reshape(-1, length)


def fit_recurrent(made: DataFrame, net: Recurrent, epochs: int = 30, rate: float = 0.02, folder: str | None = None) -> Trained:
    """Parameters from all ``windows`` whose next value is known."""

    def of(theta: np.ndarray, epoch: int, batch: pa.RecordBatch) -> tuple[float, np.ndarray]:
        keep = kept_units(batch["h"].to_numpy(), net.dropout, net.hidden, epoch)
        return net.gradient(theta, _windows_of(batch, net.length), batch["y"].to_numpy(), keep)

    return train(made.filter("y is not null").select("x", "y", "h"), of, net.begin(), epochs, rate, folder)


def recurrent_forecasts(made: DataFrame, net: Recurrent, trained: Trained, steps: int = 4, draws: int = 50, key: str = "ticker", confidence: float = 0.95) -> DataFrame:
    """key, step, forecast, lower and upper: forecasts are fed back. With
    dropout, bounds are quantiles of ``draws`` nets that lack units; without it null."""
    last = made.filter("y is null")
    sent = made.sparkSession.sparkContext.broadcast(trained.theta)
    shares = [(1 - confidence) / 2, (1 + confidence) / 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            h, m, s, start = batch["h"].to_numpy(), batch["m"].to_numpy(), batch["s"].to_numpy(), _windows_of(batch, net.length)

            def path(draw: int | None) -> np.ndarray:
                x, out = start, []
                keep = None if draw is None else kept_units(h, net.dropout, net.hidden, draw)
                for _ in range(steps):
                    out.append(net.predict(sent.value, x, keep))
                    x = np.hstack([x[:, 1:], out[-1][:, None]])
                return np.stack(out, 1) * s[:, None] + m[:, None]

            f = path(None)
            bounds = np.quantile(np.stack([path(k) for k in range(draws)]), shares, axis=0) if net.dropout and n else np.full((2, n, steps), np.nan)
            null = np.full(n * steps, not net.dropout)
            yield pa.RecordBatch.from_arrays(
                [batch[key].take(pa.array(np.repeat(np.arange(n), steps))), pa.array(np.tile(np.arange(1, steps + 1), n), pa.int32()), pa.array(f.reshape(-1)), *(pa.array(b.reshape(-1), mask=null) for b in bounds)],
                names=[key, "step", "forecast", "lower", "upper"],
            )

    kind = made.select(key).schema[0].dataType.simpleString()
    return last.select(key, "x", "m", "s", "h").mapInArrow(run, f"{key} {kind}, step int, forecast double, lower double, upper double")


def fit_bottleneck(rows: DataFrame, columns: Sequence[str], net: Bottleneck, epochs: int = 60, rate: float = 0.02, folder: str | None = None) -> tuple[Trained, list[tuple[float, float]]]:
    """Parameters from all rows, and mean and deviation of each column; nulls are means."""
    a = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    units = [(float(a[f"m{i}"] or 0.0), float(a[f"s{i}"] or 1.0) or 1.0) for i in range(len(columns))]

    def of(theta: np.ndarray, epoch: int, batch: pa.RecordBatch) -> tuple[float, np.ndarray]:
        return net.gradient(theta, batch["__x"].flatten().to_numpy().reshape(-1, len(columns)))

    return train(standardised(rows, columns, units).select("__x"), of, net.begin(), epochs, rate, folder), units


def standardised(rows: DataFrame, columns: Sequence[str], units: Sequence[tuple[float, float]]) -> DataFrame:
    return rows.withColumn("__x", F.array(*[F.coalesce((F.col(c).cast("double") - m) / s, F.lit(0.0)) for c, (m, s) in zip(columns, units, strict=True)]))


def odd_rows(rows: DataFrame, columns: Sequence[str], net: Bottleneck, trained: Trained, units: Sequence[tuple[float, float]], share: float = 0.95) -> DataFrame:
    """``rows`` with error (mean squared, of the row told from the bottleneck)
    and is_anomaly: above the ``share`` quantile of all errors."""
    sent = rows.sparkSession.sparkContext.broadcast(trained.theta)
    made = standardised(rows, columns, units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = net.errors(sent.value, batch["__x"].flatten().to_numpy().reshape(-1, len(columns)))
            yield batch.drop_columns(["__x"]).append_column("error", pa.array(e))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    told = made.mapInArrow(run, f"{names}, error double")
    limit = told.agg(F.percentile_approx("error", F.lit(share), F.lit(100_000)).alias("__limit"))
    return told.crossJoin(F.broadcast(limit)).withColumn("is_anomaly", F.col("error") > F.col("__limit")).drop("__limit")
