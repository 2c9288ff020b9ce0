"""Boosted trees grown on all rows at once, and a search of their parameters.

Many models grow side by side. A pass over the rows gives the histograms of one
level of all of them: sums of residuals by model, node, feature and bin, added
up where the rows lie. Rows carry no state: what earlier trees say is made
again from the trees, so a lost executor costs a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.operators.training import summed


@dataclass(frozen=True)
class Trial:
    """Parameters: depth of trees, learning rate, least rows of a leaf and the
    ridge on its value, share of rows that a tree is grown on."""

    depth: int = 3
    rate: float = 0.1
    least: int = 1
    ridge: float = 1.0
    share: float = 1.0


@dataclass
class Boosted:
    """A trial on the rows of blocks up to ``until``. A tree is split features
    and bins of its inner nodes in order of levels, then values of leaves."""

    trial: Trial
    until: int
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def nodes(self, bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        """Number of each row's node in a level."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for level in range(levels):
            k = 2**level - 1 + at
            at = 2 * at + (bins[rows, feature[k]] > cut[k])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for feature, cut, value in self.trees:
            out += self.trial.rate * value[self.nodes(bins, feature, cut, self.trial.depth)]
        return out


#: Bins of a feature; the first holds nulls as well.
BINS = 32


def edges(rows: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """Borders of bins: quantiles of each feature over all rows."""
    shares = [F.lit(k / BINS) for k in range(1, BINS)]
    got = rows.agg(*[F.percentile(F.col(c).cast("double"), F.array(*shares)).alias(c) for c in features]).first()
    return {c: sorted(set(got[c] or [])) for c in features}


def binned(rows: DataFrame, borders: dict[str, list[float]], target: str, block: Column, row: Column) -> DataFrame:
    """y, block, bins and a hash of the row's name; rows without target are left out."""

    def place(c: str) -> Column:
        return F.coalesce(F.size(F.filter(F.array(*[F.lit(e) for e in borders[c]]).cast("array<double>"), lambda e: e < F.col(c))), F.lit(0)) if borders[c] else F.lit(0)

    return rows.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("y"), block.cast("int").alias("block"), F.array(*[place(c) for c in borders]).alias("bins"), F.xxhash64(row).alias("h"))


def time_blocks(rows: DataFrame, order: str, n: int) -> Column:
    """Block (0 to n - 1) of a row: equal shares of rows in order of time; rows of one time are in one block."""
    at = rows.agg(F.percentile(F.col(order).cast("double"), F.array(*[F.lit(k / n) for k in range(1, n)])).alias("q")).first()["q"] or []
    return sum(((F.col(order).cast("double") > q).cast("int") for q in at), F.lit(0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["bins"].flatten().to_numpy().reshape(batch.num_rows, -1)


def _drawn(h: np.ndarray, share: float, tree: int) -> np.ndarray:
    """Rows that a tree is grown on, by their hash and the tree's number."""
    if share >= 1:
        return np.ones(len(h), bool)
    mixed = (h.astype(np.uint64) + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(11)).astype(float) / 2**53 < share


def start(rows: DataFrame, models: Sequence[Boosted]) -> None:
    """Means of the targets of each model's rows."""
    until = np.array([m.until for m in models])
    n = len(models)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        seen = (batch["block"].to_numpy()[:, None] <= until).astype(float)
        return np.concatenate([batch["y"].to_numpy() @ seen, seen.sum(0)])

    got = summed(rows, of, 2 * n)
    for k, m in enumerate(models):
        m.base = float(got[k] / got[n + k]) if got[n + k] else 0.0


def grow(rows: DataFrame, models: Sequence[Boosted], width: int, rounds: int) -> None:
    """Adds trees to all models: a pass of all rows for each level of a tree."""
    for _ in range(rounds):
        made = [(np.zeros(2**m.trial.depth - 1, np.int64), np.full(2**m.trial.depth - 1, BINS), np.zeros(2**m.trial.depth)) for m in models]
        for level in range(max(m.trial.depth for m in models)):
            live = [k for k, m in enumerate(models) if m.trial.depth > level]
            each = 2**level * width * BINS
            parts = [(models[k], made[k]) for k in live]

            def of(batch: pa.RecordBatch, parts=parts, each=each, level=level) -> np.ndarray:
                bins, y, block, h = _matrix(batch), batch["y"].to_numpy(), batch["block"].to_numpy(), batch["h"].to_numpy()
                out = np.zeros((len(parts), 2, each))
                for k, (m, (feature, cut, _)) in enumerate(parts):
                    on = np.flatnonzero((block <= m.until) & _drawn(h, m.trial.share, len(m.trees)))
                    mine = bins[on]
                    rest = y[on] - m.predict(mine)
                    cell = (m.nodes(mine, feature, cut, level)[:, None] * width + np.arange(width)) * BINS + mine
                    out[k, 0] = np.bincount(cell.reshape(-1), np.repeat(rest, width), each)
                    out[k, 1] = np.bincount(cell.reshape(-1), minlength=each)
                return out.reshape(-1)

            sums = summed(rows, of, len(parts) * 2 * each).reshape(len(parts), 2, 2**level, width, BINS)
            for k, (m, (feature, cut, value)) in enumerate(parts):
                left, count = sums[k].cumsum(-1)
                total, n = left[:, :1, -1:], count[:, :1, -1:]
                right, other = total - left, n - count
                worth = left**2 / (count + m.trial.ridge) + right**2 / (other + m.trial.ridge) - total**2 / (n + m.trial.ridge)
                worth = np.where((count >= m.trial.least) & (other >= m.trial.least), np.round(worth, 9), -1.0)
                best = worth.reshape(2**level, -1).argmax(1)
                f, b = best // BINS, best % BINS
                node = np.arange(2**level)
                split = worth[node, f, b] > 0
                b = np.where(split, b, BINS - 1)
                at = 2**level - 1 + node
                feature[at], cut[at] = f, np.where(split, b, BINS)
                if level == m.trial.depth - 1:
                    value[2 * node] = left[node, f, b] / (count[node, f, b] + m.trial.ridge + 1e-300)
                    value[2 * node + 1] = right[node, f, b] / (other[node, f, b] + m.trial.ridge + 1e-300)
        for m, tree in zip(models, made, strict=True):
            m.trees.append(tree)


def errors(rows: DataFrame, models: Sequence[Boosted]) -> np.ndarray:
    """Root mean squared error of each model on the block after its rows."""
    n = len(models)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        bins, y, block = _matrix(batch), batch["y"].to_numpy(), batch["block"].to_numpy()
        out = np.zeros((2, n))
        for k, m in enumerate(models):
            on = block == m.until + 1
            out[:, k] = ((y[on] - m.predict(bins[on])) ** 2).sum(), on.sum()
        return out.reshape(-1)

    sse, count = summed(rows, of, 2 * n).reshape(2, n)
    return np.sqrt(sse / np.maximum(count, 1))


@dataclass
class Search:
    """history: a row for each trial and rung; best trial; its model of all rows."""

    history: list[tuple]
    best: Trial
    model: Boosted


def search(rows: DataFrame, width: int, trials: Sequence[Trial], folds: int = 3, budgets: Sequence[int] = (4, 8, 16), keep: float = 0.5) -> Search:
    """Successive halving over folds in order of time.

    Fold f learns from blocks 0 to f and is judged on block f + 1, so none sees
    what comes after it. After each budget of trees the trials are ranked by
    their mean error over folds (ties: the earlier trial), a share of them goes
    on, and their trees go on growing. ``rows``: what ``binned`` gives, of
    folds + 1 blocks. The best is grown on all rows to the last budget.
    """
    rows = rows.cache()
    models = {(t, f): Boosted(trial, f) for t, trial in enumerate(trials) for f in range(folds)}
    start(rows, list(models.values()))
    live, grown, history = list(range(len(trials))), 0, []
    for rung, budget in enumerate(budgets):
        now = [models[t, f] for t in live for f in range(folds)]
        grow(rows, now, width, budget - grown)
        grown = budget
        mean = errors(rows, now).reshape(len(live), folds).mean(1)
        order = np.lexsort((live, np.round(mean, 12)))
        kept = {live[i] for i in (order[: max(1, int(len(live) * keep))] if budget != budgets[-1] else order[:1])}
        history += [(rung, t, budget, float(e), t in kept) for t, e in zip(live, mean, strict=True)]
        live = [t for t in live if t in kept]
    best = Boosted(trials[live[0]], folds)
    start(rows, [best])
    grow(rows, [best], width, budgets[-1])
    rows.unpersist()
    return Search(history, trials[live[0]], best)


def history_rows(spark, found: Search, trials: Sequence[Trial]) -> DataFrame:
    kind = "rung int, trial int, depth int, rate double, least int, ridge double, share double, trees int, rmse double, kept boolean"
    return spark.createDataFrame([(rung, t, trials[t].depth, trials[t].rate, trials[t].least, trials[t].ridge, trials[t].share, n, e, kept) for rung, t, n, e, kept in found.history], kind)
