"""Boosted trees against a plain version, and the search of their parameters."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from finweave.operators import boosting
from finweave.operators.boosting import Boosted, Trial


def frame(spark, x, y, t, parts=5):
    names = [f"x{k}" for k in range(x.shape[1])]
    rows = [(i, int(t[i]), float(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "i int, t int, y double, " + ", ".join(f"{n} double" for n in names)).repartition(parts), names


def prepared(spark, x, y, t, blocks):
    df, names = frame(spark, x, y, t)
    borders = boosting.edges(df, names)
    return boosting.binned(df, borders, "y", boosting.time_blocks(df, "t", blocks), F.col("i")).cache(), borders


def plain_tree(bins, rest, trial, depth=0):
    """Values of the rows of one tree, by all splits of all features."""
    n, s = len(rest), rest.sum()
    if depth == trial.depth:
        return np.full(n, s / (n + trial.ridge + 1e-300))
    best, at = 0.0, None
    for f in range(bins.shape[1]):
        for b in range(boosting.BINS):
            left = bins[:, f] <= b
            nl = left.sum()
            if nl >= trial.least and n - nl >= trial.least:
                worth = round(rest[left].sum() ** 2 / (nl + trial.ridge) + rest[~left].sum() ** 2 / (n - nl + trial.ridge) - s**2 / (n + trial.ridge), 9)
                if worth > best:
                    best, at = worth, (f, b)
    if at is None:
        return plain_tree(bins, rest, trial, depth + 1)
    left = bins[:, at[0]] <= at[1]
    out = np.zeros(n)
    out[left], out[~left] = plain_tree(bins[left], rest[left], trial, depth + 1), plain_tree(bins[~left], rest[~left], trial, depth + 1)
    return out


def test_trees_are_those_of_a_plain_version(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(150, 3))
    x[g.random(x.shape) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 0]) * 2 + (np.nan_to_num(x[:, 1]) > 0) + g.normal(size=150) * 0.1
    rows, _ = prepared(spark, x, y, np.arange(150), 3)
    models = [Boosted(Trial(2, 0.3, 5, 1.0), 2), Boosted(Trial(3, 0.5, 1, 0.1), 2), Boosted(Trial(1, 0.2), 0)]
    boosting.start(rows, models)
    boosting.grow(rows, models, 3, 4)
    got = rows.collect()
    bins, yy, block = np.array([r["bins"] for r in got]), np.array([r["y"] for r in got]), np.array([r["block"] for r in got])
    for m in models:
        on = block <= m.until
        want = np.full(on.sum(), yy[on].mean())
        for _ in range(4):
            want += m.trial.rate * plain_tree(bins[on], yy[on] - want, m.trial)
        assert np.allclose(m.predict(bins[on]), want, atol=1e-9)
    after = block == 1
    assert np.isclose(boosting.errors(rows, models[2:])[0], np.sqrt(((yy[after] - models[2].predict(bins[after])) ** 2).mean()))


def test_no_fold_sees_its_future(spark):
    g = np.random.default_rng(2)
    x, y, t = g.normal(size=(200, 2)), g.normal(size=200), np.arange(200)
    later = np.where(t >= 100, 1e6 * y, y)
    models = []
    for target in (y, later):
        rows, _ = prepared(spark, x, target, t, 4)
        m = [Boosted(Trial(2, 0.3, share=0.7), 1)]
        boosting.start(rows, m)
        boosting.grow(rows, m, 2, 3)
        models.append(m[0])
    bins = g.integers(0, boosting.BINS, size=(50, 2))
    assert np.allclose(models[0].predict(bins), models[1].predict(bins))


def test_planted_best_of_a_grid(spark):
    """A product of signs needs depth 2; a low rate does not get there in few trees."""
    g = np.random.default_rng(3)
    x = g.uniform(-1, 1, size=(1200, 3))
    x[:, :2] += 0.2 * np.sign(x[:, :2])
    y = 3 * np.sign(x[:, 0] - 0.1) * np.sign(x[:, 1] + 0.1) + 0.2 * g.normal(size=1200)
    rows, _ = prepared(spark, x, y, np.arange(1200), 4)
    trials = [Trial(1, 0.5), Trial(1, 0.1), Trial(3, 0.02), Trial(3, 0.5), Trial(2, 0.02), Trial(3, 0.01, share=0.5)]
    found = boosting.search(rows, 3, trials, 3, (1, 2, 4))
    assert found.best == trials[3]
    rungs = {r: [h for h in found.history if h[0] == r] for r in range(3)}
    assert [len(rungs[r]) for r in range(3)] == [6, 3, 1] and all({h[1] for h in rungs[r] if h[4]} == {h[1] for h in rungs[r + 1]} for r in range(2))
    assert rungs[2][0][3] < 1.2 and boosting.history_rows(spark, found, trials).count() == 10
    bins = np.array([r["bins"] for r in rows.collect()])
    assert len(found.model.trees) == 4 and found.model.predict(bins).std() > 2


@pytest.mark.parametrize("rows", [[], [(1, 1, None, 1.0)], [(1, 1, 2.0, None), (2, 2, 4.0, None)]])
def test_tables_without_much(spark, rows):
    df = spark.createDataFrame(rows, "i int, t int, y double, x0 double")
    made = boosting.binned(df, boosting.edges(df, ["x0"]), "y", boosting.time_blocks(df, "t", 2), F.col("i"))
    found = boosting.search(made, 1, [Trial(1), Trial(2)], 1, (1, 2))
    assert np.isfinite(found.model.predict(np.zeros((1, 1), np.int64))).all()


def test_query_over_whole_tables(spark):
    """Errors of the last rung against plain boosting of the same trial and folds."""
    from finweave.plans import models

    sf = "/root/testdata/sf0.001"
    got = models.boosting_search(spark, sf).collect()
    last = next(r for r in got if r["rung"] == max(x["rung"] for x in got))
    trial = models.TRIALS[last["trial"]]
    rows = models.search_rows(spark, sf).collect()
    bins, y, block = np.array([r["bins"] for r in rows]), np.array([r["y"] for r in rows]), np.array([r["block"] for r in rows])
    told = []
    for f in range(3):
        on, after = block <= f, block == f + 1
        m = Boosted(trial, f, y[on].mean())
        want, ahead = np.full(on.sum(), y[on].mean()), np.full(after.sum(), y[on].mean())
        assert trial.share == 1
        for _ in range(last["trees"]):
            both = paired_tree(bins[on], y[on] - want, bins[after], trial)
            want, ahead = want + trial.rate * both[0], ahead + trial.rate * both[1]
        told.append(np.sqrt(((y[after] - ahead) ** 2).mean()))
        assert m.base == y[on].mean()
    assert np.isclose(np.mean(told), last["rmse"], rtol=1e-6)


def paired_tree(bins, rest, others, trial, depth=0):
    """A plain tree's values of its own rows and of others."""
    n, s = len(rest), rest.sum()
    if depth == trial.depth:
        v = s / (n + trial.ridge + 1e-300)
        return np.full(n, v), np.full(len(others), v)
    best, at = 0.0, None
    for f in range(bins.shape[1]):
        for b in range(boosting.BINS):
            left = bins[:, f] <= b
            nl = left.sum()
            if nl >= trial.least and n - nl >= trial.least:
                worth = round(rest[left].sum() ** 2 / (nl + trial.ridge) + rest[~left].sum() ** 2 / (n - nl + trial.ridge) - s**2 / (n + trial.ridge), 9)
                if worth > best:
                    best, at = worth, (f, b)
    if at is None:
        return paired_tree(bins, rest, others, trial, depth + 1)
    own, out = np.zeros(n), np.zeros(len(others))
    for a, b in ((bins[:, at[0]] <= at[1], others[:, at[0]] <= at[1]), (bins[:, at[0]] > at[1], others[:, at[0]] > at[1])):
        own[a], out[b] = paired_tree(bins[a], rest[a], others[b], trial, depth + 1)
    return own, out
