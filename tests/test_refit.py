"""Refitted models against numpy with the same draws; coverage of planted values."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from finweave.operators import refit


def drawn(row, replicates):
    out = [1]
    for r in range(replicates):
        u = int(hashlib.md5(f"{row}:{r // 4}".encode()).hexdigest()[r % 4 * 8 : r % 4 * 8 + 8], 16) / 2**32
        out.append(sum(u >= p for p in refit.POISSON))
    return out


def test_same_draws_same_fits(spark):
    g = np.random.default_rng(1)
    rows = [(f"k{i % 3}", i, *map(float, g.normal(size=3))) for i in range(90)] + [("k1", 90, None, 1.0, 1.0), ("few", 91, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, i int, a double, b double, y double").repartition(5)
    got = {(r["k"], r["replicate"]): r for r in refit.refits(df, "y", ["a", "b"], ["k"], F.concat("k", F.lit("/"), F.col("i").cast("string")), 13).collect()}
    for key in ("k0", "k1", "k2"):
        mine = [r for r in rows if r[0] == key and None not in r]
        w = np.array([drawn(f"{r[0]}/{r[1]}", 13) for r in mine])
        x, y = np.array([[1, r[2], r[3]] for r in mine]), np.array([r[4] for r in mine])
        for k in range(14):
            s = np.sqrt(w[:, k])
            assert got[key, k]["n"] == w[:, k].sum()
            assert np.allclose(got[key, k]["coefficients"], np.linalg.lstsq(x * s[:, None], y * s, rcond=None)[0], atol=1e-8)
    assert got["few", 0]["coefficients"] is None


def test_draws_are_poisson():
    w = np.array([drawn(f"r{i}", 200)[1:] for i in range(300)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w[:, :8].T)[np.triu_indices(8, 1)]).max() < 0.2


def test_intervals_cover_planted_values_at_their_rate(spark):
    g = np.random.default_rng(7)
    rows = []
    for k in range(200):
        x = g.normal(size=120)
        rows += [(f"k{k}", i, float(a), float(2 + 0.7 * a + g.normal())) for i, a in enumerate(x)]
    fitted = refit.refits(spark.createDataFrame(rows, "k string, i int, x double, y double"), "y", ["x"], ["k"], F.concat("k", F.lit(":"), F.col("i").cast("string")), 200)
    got = refit.coefficient_intervals(fitted, ["x"], ["k"]).collect()
    for name, planted in (("constant", 2), ("x", 0.7)):
        inside = np.mean([r["lower"] <= planted <= r["upper"] for r in got if r["coefficient"] == name])
        assert 0.9 <= inside <= 0.98
    assert all(r["lower"] < r["estimate"] < r["upper"] and r["replicates"] == 200 for r in got)


def test_recursion_with_time(spark):
    fitted = spark.createDataFrame([("a", 0, 9, [1.0, 0.5, 0.1]), ("a", 1, 9, [1.0, 0.5, 0.1]), ("a", 2, 9, None)], "k string, replicate int, n long, coefficients array<double>")
    last = spark.createDataFrame([("a", 4.0, 10.0)], "k string, value double, time double")
    got = {r["step"]: r for r in refit.recursive_forecasts(fitted, last, ["k"], 3).collect()}
    f = 4.0
    for h in (1, 2, 3):
        f = 1 + 0.5 * f + 0.1 * (10 + h)
        assert np.isclose(got[h]["estimate"], f) and np.isclose(got[h]["lower"], f) and got[h]["replicates"] == 1
