"""Data-parallel training: sums of vectors over all rows, and what steps on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of a vector that ``of`` makes of a batch. Tasks
    add up their batches and send what isn't 0; sums meet in the shuffle, and
    ``width`` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["i", "v"])

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(width)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


class Adam:
    """Steps along summed gradients."""

    def __init__(self, width: int, rate: float):
        self.rate, self.k, self.m, self.v = rate, 0, np.zeros(width), np.zeros(width)

    def step(self, theta: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.k += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.99 * self.v + 0.01 * gradient**2
        return theta - self.rate * (self.m / (1 - 0.9**self.k)) / (np.sqrt(self.v / (1 - 0.99**self.k)) + 1e-8)
