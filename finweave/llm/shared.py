"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: ``spark.checkpoint.dir`` of
    the session. Where that is unset (tests on one machine) a folder under the
    temp directory is used and set for the session's checkpoints as well."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + os.path.join(tempfile.gettempdir(), "finweave-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/finweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: What this driver has written with ``materialise`` and not forgotten.
_written: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. Cuts the lineage in
    a way that survives lost executors and keeps column pruning for readers."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    return len(_written)


def forget(spark: SparkSession, since: int) -> None:
    """Deletes what was written after ``written()`` was ``since``, but for the
    last: for a caller who has just written its result and needs no more."""
    gone, _written[since:] = _written[since:-1], _written[-1:]
    for path in gone:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clean(spark: SparkSession) -> bool:
    """Deletes what this application's operators have written to the shared
    folder. For after the last use of their results, which read from there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/finweave/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left side's keys."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


#: Rows of one key that a task may take whatever their share.
HOT_ROWS = 512


def hot_keys(df: DataFrame, keys: Sequence[str], sizes: DataFrame | None = None, least: int = HOT_ROWS) -> DataFrame:
    """``keys`` and parts (int, 2 or more) of the keys that have more rows than
    ``least`` and than a quarter of a mean shuffle partition. So they are fewer
    than four times the shuffle partitions, however large ``df`` is. ``sizes``:
    keys and their numbers of rows (column n), if these are known."""
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    least = max(least, df.count() // (4 * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return sizes.filter(F.col("n") > least).select(*keys, F.ceil(F.col("n") / least).cast("int").alias("__parts"))


def spread_join(many: DataFrame, few: DataFrame, keys: Sequence[str], by: Sequence[str] = (), hot: DataFrame | None = None) -> DataFrame:
    """Null-safe inner equi-join of a side with hot keys to one with few rows
    of each key: rows of a hot key are dealt to parts by a hash of ``by`` (all
    columns, if none are named), and the other side's rows of that key go to
    each part. ``hot`` is what ``hot_keys`` finds (in ``many``, which is best
    written then, if it isn't given); it is broadcast, within that bound."""
    hot = materialise(hot_keys(many, keys) if hot is None else hot, "hot-keys")
    if hot.isEmpty():
        return join_same(many, few, keys)
    hot = F.broadcast(hot)
    dealt = join_same(many, hot, keys, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*(by or many.columns)), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    each = join_same(few, hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return join_same(dealt, each, [*keys, "__part"]).drop("__part")


def prefix_sum(df: DataFrame, group: Sequence[str], levels: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` in each ``group`` in the order
    ``levels`` then ``order`` (nulls first), without a task that holds a group.

    Totals are summed per level first; a window at level *k* sees only the
    distinct values of level *k* below one parent, and the last window sees
    only the rows of one finest cell. ``levels`` must therefore split hot
    groups: the last one is usually a few hundred hash buckets.
    """
    group, levels = list(group), list(levels)
    finest = group + levels
    totals = df.groupBy(*finest).agg(F.sum(value).alias("__t0"))
    base: DataFrame | None = None
    sums: list[DataFrame] = []
    for k in range(len(levels)):
        keys = group + levels[: k + 1]
        at = totals if k == len(levels) - 1 else totals.groupBy(*keys).agg(F.sum("__t0").alias("__t0"))
        w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        sums.append(at.select(*keys, F.coalesce(F.sum("__t0").over(w), F.lit(0)).alias(f"__b{k}")))
    base = sums[-1]
    for k in range(len(levels) - 1):
        base = join_same(base, sums[k], group + levels[: k + 1])
    base = base.select(*finest, sum((F.col(f"__b{k}") for k in range(1, len(levels))), F.col("__b0")).alias("__base"))
    w = Window.partitionBy(*finest).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return join_same(rows, base, finest).withColumn(out, F.col("__base") + F.col("__in")).drop("__base", "__in")


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df`` for a step in Python. With the default of 10,000 rows, long texts
    make huge batches, so a session that has not set the size of its Arrow
    batches in bytes gets one of 8 MB; one that has, in whatever unit, keeps it."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) in (None, "", "-1", "2147483647", "2147483647b"):
        conf.set(BATCH, "8m")
    return df


_caches: dict[str, Callable[[], None]] = {}
_user = ""


def keeps(name: str, clear: Callable[[], None]) -> None:
    """Registers a cache that a Python worker keeps over tasks."""
    _caches[name] = clear


def working(name: str) -> None:
    """Called by a task at its start: workers outlive stages, so what another
    kind of task has kept is dropped and given back to the system."""
    global _user
    if _user != name:
        for other, clear in _caches.items():
            if other != name:
                clear()
        trim()
        _user = name


def trim() -> None:
    """Gives unused memory of Arrow's pool and of malloc back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
