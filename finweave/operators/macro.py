"""Macro series (series_id, date, value)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.functions import constants as K
from finweave.functions.num import Series, div

S = Series(("series_id",), ("date",))


def named(series: DataFrame) -> DataFrame:
    """Adds series_name: the known name of an id, else the id."""
    names = F.create_map(*[x for n, i in {**K.MACRO_SERIES, **K.RECESSION_SERIES, **K.CONDITION_SERIES, **K.NOWCAST_SERIES}.items() for x in (F.lit(i), F.lit(n))])
    return series.withColumn("series_name", F.coalesce(F.try_element_at(names, F.col("series_id")), F.col("series_id")))


def changes(series: DataFrame, diffs: Sequence[int] = (1, 5, 21, 63, 252), pcts: Sequence[int] = (21, 63, 252), means: Sequence[int] = (30, 90, 252)) -> DataFrame:
    """Differences, percent changes (not for rates, spreads and ratios), moving means, z-score."""
    level = F.col("series_id").rlike("(?i)rate|spread|ratio")
    cols = {f"change_{n}d": S.diff("value", n) for n in diffs}
    cols |= {f"pct_change_{n}d": F.when(~level, S.change("value", n) * 100) for n in pcts}
    cols |= {f"ma_{n}d": S.mean("value", n) for n in means}
    n = means[-1]
    return series.withColumns(cols | {"zscore": div(F.col("value") - S.mean("value", n), S.std("value", n))})


def features_at(series: DataFrame, day: str, steps: Sequence[int] = (5, 21, 63, 252), means: Sequence[int] = (21, 63, 252), vol: int = 21) -> DataFrame:
    """Features of each series at its last date up to ``day``."""
    d = series.withColumns({f"change_{n}": S.diff("value", n) for n in steps} | {f"ma_{n}": S.mean("value", n) for n in means} | {"__r": S.change("value")})
    n = means[-1]
    d = d.withColumns({f"vol_{vol}": S.std("__r", vol), f"zscore_{n}": div(F.col("value") - F.col(f"ma_{n}"), S.std("value", n))})
    names = ["value", *[f"change_{k}" for k in steps], *[f"ma_{k}" for k in means], f"vol_{vol}", f"zscore_{n}"]
    last = d.filter(F.col("date") <= F.lit(day).cast("date")).groupBy("series_id").agg(F.max_by(F.struct("date", *names), "date").alias("x"))
    return last.select("series_id", "x.*")


def wide(series: DataFrame, ids: Sequence[str], fill: bool = True) -> DataFrame:
    """One column per series; gaps hold the last value. Union-then-pivot: one
    exchange whatever the number of series. The last step orders all dates,
    whose number is that of days."""
    w = series.groupBy("date").pivot("series_id", list(ids)).agg(F.min("value"))
    if not fill:
        return w
    by = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return w.select("date", *[F.last(i, ignorenulls=True).over(by).alias(i) for i in ids])


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, value: Sequence[str]) -> DataFrame:
    """Each left row with the right values at the latest time not after its
    own: one union and one window instead of a range join."""
    cols = [c for c in left.columns if c not in keys and c != on]
    r = right.select(*keys, on, F.lit(0).alias("__side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.struct(*value).alias("__v"))
    kind = r.schema["__v"].dataType
    lhs = left.select(*keys, on, F.lit(1).alias("__side"), *cols, F.lit(None).cast(kind).alias("__v"))
    w = Window.partitionBy(*keys).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    u = r.unionByName(lhs).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    return u.select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in value])


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean of what is not null."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return div(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols]), n)


def composite(w: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Mean of the columns' z-scores over the sample."""
    stats = w.agg(*[x for i in ids for x in (F.avg(i).alias(f"__a_{i}"), F.stddev_samp(i).alias(f"__s_{i}"))])
    z = [div(F.col(i) - F.col(f"__a_{i}"), f"__s_{i}") for i in ids]
    return w.crossJoin(F.broadcast(stats)).select("date", *ids, row_mean(z).alias("composite"))


def derived(w: DataFrame) -> DataFrame:
    """Slope, inversion, real rate and employment strength of a wide frame;
    null where a series is missing."""
    have = w.withColumns({c: F.lit(None).cast("double") for c in ("treasury_10y", "treasury_2y", "fed_funds_rate", "cpi_all", "unemployment_rate", "nonfarm_payrolls") if c not in w.columns})
    c = F.col
    slope = c("treasury_10y") - c("treasury_2y")
    return have.withColumns({"yield_curve_slope": slope, "yield_curve_inverted": (slope < 0).cast("int"), "real_rate": c("fed_funds_rate") - c("cpi_all"), "employment_strength": c("nonfarm_payrolls") * (1 - c("unemployment_rate") / 100)})


def nowcast(series: DataFrame) -> DataFrame:
    """Latest value and its date of each series."""
    return series.filter("value is not null").groupBy("series_id").agg(F.max_by("value", "date").alias("value"), F.max("date").alias("date"))


def search(info: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Series whose id or title holds the text, first by id."""
    hit = F.lower(F.concat_ws(" ", "series_id", "title")).contains(text.lower())
    return info.filter(hit).orderBy("series_id").limit(limit).withColumn("notes", F.substring("notes", 1, 500))
