"""Arrow batches of bounded text size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that one step in Python takes at once.
STEP_BYTES = 4_000_000


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to rows of at most ``limit`` bytes of text (one row at
    least), so what Python makes of them at once doesn't grow with the input."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(docs: DataFrame) -> DataFrame:
    """``docs`` for a step in Python: a session that has not set the size of
    its Arrow batches in bytes gets batches of 8 MB, as 10,000 long texts are
    a huge one."""
    conf = docs.sparkSession.conf
    if conf.get(_BYTES, None) in (None, "", "-1", "67108864", "64MB", "2147483647", "2147483647b"):
        conf.set(_BYTES, "8m")
    return docs
