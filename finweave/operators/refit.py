"""Bootstrap intervals of linear models by refitting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The distribution function of Poisson counts with mean 1, up to where 2 ** -32 ends.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217)


def weights(row: Column, replicates: int) -> Column:
    """How often a row is drawn in each replicate, an array: Poisson counts
    from 8 digits of an md5 of the row's name and the replicate's block, so
    they are the same in any partitioning. Replicate 0 has each row once."""
    digits = F.transform(F.sequence(F.lit(0), F.lit((replicates + 3) // 4 - 1)), lambda b: F.md5(F.concat(row, F.lit(":"), b.cast("string"))))
    parts = lambda d: F.array(*[F.conv(F.substring(d, i, 8), 16, 10).cast("double") / 2.0**32 for i in (1, 9, 17, 25)])
    u = F.slice(F.flatten(F.transform(digits, parts)), 1, replicates)
    count = lambda x: sum((x >= p).cast("int") for p in POISSON)
    return F.concat(F.array(F.lit(1)), F.transform(u, count))


def refits(rows: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], row: Column, replicates: int = 100) -> DataFrame:
    """keys, replicate (0: the data themselves), n (drawn rows) and
    coefficients (constant, then xs) of least squares in each replicate.

    The weighted sums of products of all replicates are one aggregate, added
    up where the rows lie: what is shuffled is keys times replicates, a few
    numbers each. Rows with a null are left out. A replicate that draws too few
    different rows has null coefficients.
    """
    names = ["__1", *xs, y]
    d = rows.select(*keys, row.alias("__row"), *[F.col(c).cast("double").alias(c) for c in (*xs, y)]).withColumn("__1", F.lit(1.0))
    d = d.na.drop(subset=[*xs, y]).withColumn("__w", weights(F.col("__row"), replicates)).select(*keys, *names, F.posexplode("__w").alias("replicate", "w")).filter("w > 0")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = d.groupBy(*keys, "replicate").agg(*[F.sum(F.col("w") * F.col(names[i]) * F.col(names[j])).alias(f"__s{i}_{j}") for i, j in pairs])
    k = len(names) - 1
    made = sums.select(*keys, "replicate", F.array(*[F.col(f"__s{i}_{j}") for i, j in pairs]).alias("sums"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array(batch["sums"].to_pylist(), float).reshape(-1, len(pairs))
            g = np.zeros((len(s), k + 1, k + 1))
            for c, (i, j) in enumerate(pairs):
                g[:, i, j] = g[:, j, i] = s[:, c]
            d = np.sqrt(np.maximum(np.diagonal(g, axis1=1, axis2=2)[:, :k], 1e-300))
            a, b = g[:, :k, :k] / d[:, :, None] / d[:, None, :], g[:, :k, k] / d
            fine = np.linalg.matrix_rank(a, tol=1e-10, hermitian=True) == k if len(a) else np.zeros(0, bool)
            beta = np.full((len(s), k), np.nan)
            beta[fine] = np.linalg.solve(a[fine], b[fine][:, :, None])[:, :, 0] / d[fine]
            cols = [batch[c] for c in (*keys, "replicate")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(g[:, 0, 0].round(), pa.float64()).cast(pa.int64()), pa.array([list(v) if f else None for v, f in zip(beta, fine, strict=True)], pa.list_(pa.float64()))], names=[*keys, "replicate", "n", "coefficients"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys).schema)
    return made.mapInArrow(run, f"{head}, replicate int, n long, coefficients array<double>")


def quantiles(values: DataFrame, keys: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    """keys, estimate (replicate 0), lower, upper and replicates counted."""
    own, drawn = F.when(F.col("replicate") == 0, F.col(value)), F.when(F.col("replicate") > 0, F.col(value))
    a = values.groupBy(*keys).agg(F.max(own).alias("estimate"), F.percentile(drawn, F.array(F.lit((1 - confidence) / 2), F.lit((1 + confidence) / 2))).alias("__q"), F.count(drawn).alias("replicates"))
    return a.select(*keys, "estimate", F.get("__q", F.lit(0)).alias("lower"), F.get("__q", F.lit(1)).alias("upper"), "replicates")


def coefficient_intervals(fitted: DataFrame, names: Sequence[str], keys: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """keys, coefficient and its interval."""
    each = fitted.select(*keys, "replicate", F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in ("constant", *names)]).alias("name"), F.col("coefficients").alias("value"))).alias("c"))
    return quantiles(each.select(*keys, "replicate", F.col("c.name").alias("coefficient"), F.col("c.value").alias("value")), [*keys, "coefficient"], "value", confidence)


def recursive_forecasts(fitted: DataFrame, last: DataFrame, keys: Sequence[str], steps: int = 4, confidence: float = 0.95) -> DataFrame:
    """keys, step, estimate and interval of forecasts of models of a value on
    its last one and, if it has a third coefficient, a count of time: each
    replicate's forecasts are fed back to it. ``last``: keys, value and time
    that go before the first step."""
    both = last.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("value").cast("double").alias("value"), F.col("time").cast("double").alias("time"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    d = fitted.filter("coefficients is not null").join(both, on)
    b = lambda i: F.coalesce(F.get("coefficients", F.lit(i)), F.lit(0.0))
    first = F.array(F.col("value"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda a, h: F.concat(a, F.array(b(0) + b(1) * F.element_at(a, -1) + b(2) * (F.col("time") + h))))
    each = d.select(*keys, "replicate", F.posexplode(F.slice(path, 2, steps)).alias("i", "f"))
    return quantiles(each.select(*keys, "replicate", (F.col("i") + 1).alias("step"), "f"), [*keys, "step"], "f", confidence)
