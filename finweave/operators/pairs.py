"""Moments of all pairs of series that share days."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finweave.functions.num import div

#: Series whose products are made at once: bounds the memory of a task.
BLOCK = 512


def pair_sums(rows: DataFrame, at: str = "date", name: str = "asset", value: str = "ret") -> DataFrame:
    """a, b (a <= b), n, and sums sx, sy, sxx, syy, sxy of both series' values
    less their means, over the days that both have.

    A day is one vector; a task multiplies the matrix of its days with itself,
    block by block, and its k * k sums are what is shuffled, not the pairs of
    every day. Values without a day or a name are left out; of several values
    of one name and day the mean counts.
    """
    known = rows.select(F.col(at).alias("at"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("v")).filter("at is not null and name is not null and v is not null and not isnan(v)")
    known = known.groupBy("at", "name").agg(F.avg("v").alias("v"))
    means = known.groupBy("name").agg(F.avg("v").alias("m")).withColumnRenamed("name", "of")
    days = known.join(means, F.col("name") == F.col("of")).groupBy("at").agg(F.collect_list(F.struct("name", (F.col("v") - F.col("m")).alias("v"))).alias("day"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            day = batch["day"]
            flat = day.flatten()
            names = flat.field("name").dictionary_encode()
            order = np.argsort(np.array(names.dictionary.to_pylist(), object))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            label = names.dictionary.take(pa.array(order))
            row = np.repeat(np.arange(len(day)), np.diff(day.offsets.to_numpy()))
            x = np.full((len(day), len(order)), np.nan)
            x[row, place[names.indices.to_numpy()]] = flat.field("v").to_numpy()
            on = np.isfinite(x).astype(float)
            x = np.nan_to_num(x)
            for i in range(0, len(order), BLOCK):
                for j in range(i, len(order), BLOCK):
                    xa, xb, a, b = x[:, i : i + BLOCK], x[:, j : j + BLOCK], on[:, i : i + BLOCK], on[:, j : j + BLOCK]
                    n = a.T @ b
                    left, right = np.nonzero((n > 0) & (np.arange(i, i + n.shape[0])[:, None] <= np.arange(j, j + n.shape[1])))
                    sums = [m[left, right] for m in (n, xa.T @ b, a.T @ xb, (xa * xa).T @ b, a.T @ (xb * xb), xa.T @ xb)]
                    yield pa.RecordBatch.from_arrays([label.take(pa.array(left + i)), label.take(pa.array(right + j)), *(pa.array(v) for v in sums)], names=["a", "b", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = days.select("day").mapInArrow(run, "a string, b string, n double, sx double, sy double, sxx double, syy double, sxy double")
    sums = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    left, right = (means.select(F.col("of").alias(c), F.col("m").alias(m)) for c, m in (("a", "mean_a"), ("b", "mean_b")))
    return sums.join(left, "a").join(right, "b").select("a", "b", F.col("n").cast("long").alias("n"), "sx", "sy", "sxx", "syy", "sxy", (F.col("mean_a") + F.col("sx") / F.col("n")).alias("mean_a"), (F.col("mean_b") + F.col("sy") / F.col("n")).alias("mean_b"))


def with_covariance(sums: DataFrame) -> DataFrame:
    """Adds covariance (sample) and correlation of ``pair_sums``; null where they are not defined."""
    n = F.col("n")
    part = lambda xy, x, y: F.col(xy) - F.col(x) * F.col(y) / n
    cov, vx, vy = part("sxy", "sx", "sy"), part("sxx", "sx", "sx"), part("syy", "sy", "sy")
    few = n < 2
    return sums.withColumns({"covariance": F.when(~few, div(cov, n - 1)), "correlation": F.when(~few & (vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))})
