"""Anomalies in long series (key, date, metric, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.functions import constants as K
from finweave.functions.num import div, norm_ppf

KEYS = ("ticker", "metric")


def rank_of(severity: Column) -> Column:
    out = F.lit(0)
    for i, s in enumerate(K.SEVERITIES):
        out = F.when(severity == s, i + 1).otherwise(out)
    return out


def statistical(rows: DataFrame, sensitivity: float = 0.95) -> DataFrame:
    """Values whose z-score is beyond the normal quantile: severity by 3 and 4
    deviations, expected range two sample deviations about the mean. Moments
    come from a small aggregate that is joined back."""
    limit = norm_ppf(sensitivity)
    m = rows.filter("value is not null").groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd0"), F.stddev_samp("value").alias("sd1"))
    z = F.abs(div(F.col("value") - F.col("mean"), "sd0"))
    j = rows.join(m, list(KEYS)).withColumn("score", z).filter(F.col("score") > limit)
    severity = F.when(F.col("score") > 4, "high").when(F.col("score") > 3, "medium").otherwise("low")
    return j.select(*KEYS, "date", "value", "score", severity.alias("severity"), (F.col("mean") - 2 * F.col("sd1")).alias("expected_low"), (F.col("mean") + 2 * F.col("sd1")).alias("expected_high"), F.lit("statistical").alias("kind"))


def structural_breaks(rows: DataFrame, limit: float = 1.358) -> DataFrame:
    """First rows of runs in which the scaled cumulative sum of deviations is beyond the limit."""
    m = rows.filter("value is not null").groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    w = Window.partitionBy(*KEYS).orderBy("date")
    j = rows.filter("value is not null").join(m, list(KEYS))
    c = div(F.sum(F.col("value") - F.col("mean")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("sd") * F.sqrt("n"))
    j = j.withColumn("score", F.abs(c)).withColumn("hit", F.coalesce(F.col("score") > limit, F.lit(False)))
    j = j.withColumn("start", F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(False))).filter("start")
    return j.select(*KEYS, "date", "value", "score", F.lit("high").alias("severity"), F.lit(None).cast("double").alias("expected_low"), F.lit(None).cast("double").alias("expected_high"), F.lit("structural_break").alias("kind"))


def regime_changes(rows: DataFrame, n: int = 10, least: int = 20) -> DataFrame:
    """Steps of the rolling mean or spread beyond their own 95th percentile."""
    w = Window.partitionBy(*KEYS).orderBy("date")
    frame = w.rowsBetween(-(n - 1), 0)
    full = lambda agg: F.when(F.count("value").over(frame) == n, agg("value").over(frame))
    r = rows.withColumns({"m": full(F.avg), "s": full(F.stddev_samp), "size": F.count("value").over(Window.partitionBy(*KEYS))}).filter(F.col("size") >= least)
    r = r.withColumns({"dm": F.abs(F.col("m") - F.lag("m").over(w)), "ds": F.abs(F.col("s") - F.lag("s").over(w))})
    q = r.groupBy(*KEYS).agg(F.percentile("dm", F.lit(0.95)).alias("qm"), F.percentile("ds", F.lit(0.95)).alias("qs"))
    hit = (F.col("dm") > F.col("qm")) | (F.col("ds") > F.col("qs"))
    return r.join(q, list(KEYS)).filter(hit).select(*KEYS, "date", "value", F.greatest(div("dm", "qm"), div("ds", "qs")).alias("score"), F.lit("medium").alias("severity"), F.lit(None).cast("double").alias("expected_low"), F.lit(None).cast("double").alias("expected_high"), F.lit("regime_change").alias("kind"))


def combined(parts: Sequence[DataFrame]) -> DataFrame:
    """One row per key and date: greatest score, worst severity, all kinds and metrics."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("ticker", "date").agg(
        F.max("score").alias("score"),
        F.max_by("severity", rank_of(F.col("severity"))).alias("severity"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("metrics"),
        F.count(F.lit(1)).alias("findings"),
    )


#: Finest cells that a band of scores is cut into, as a power of two.
LEVELS = 20


def similar(found: DataFrame, band: float = 0.5, most: int = 5) -> DataFrame:
    """For each finding the first ``most`` others of its metric, by date and
    ticker, with a score within the band.

    Scores are cut into cells, and cells are joined two by two, ``LEVELS``
    times: what lies surely within a finding's band is at most two cells of
    each size. A cell keeps its first rows only, which are all that a band may
    need of it, so a crowd of like scores costs no pairs. Rows of the two
    finest cells at the ends of a band are compared one by one, of those with
    one score the first.
    """
    fine = float(2**LEVELS) / band
    keys, order = ["ticker", "metric", "date", "score"], ["date", "ticker"]
    rows = found.select(*keys).withColumn("q", F.floor(F.col("score") * fine).cast("long"))
    first = lambda df, by: df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order, "score"))).filter(F.col("__n") <= most + 1).drop("__n")
    like = [F.col(c).alias(f"like_{c}") for c in ("ticker", "date", "score")]
    # the cell of each size that a row is in, and the cells that make up the inside of its band
    cells = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS + 1)))).withColumn("cell", F.expr("shiftright(q, level)"))
    kept = first(cells, ["metric", "level", "cell"]).select("metric", "level", "cell", *like)
    lo, hi = F.floor((F.col("score") - band) * fine).cast("long"), F.floor((F.col("score") + band) * fine).cast("long")
    asked = rows.withColumns({"a": lo + 2, "z": hi - 1, "level": F.explode(F.sequence(F.lit(0), F.lit(LEVELS + 1)))})
    asked = asked.withColumns({"l": F.expr("shiftright(a + shiftleft(1L, level) - 1, level)"), "r": F.expr("shiftright(z, level)")}).filter("l < r")
    asked = asked.withColumn("cell", F.explode(F.filter(F.array(F.when(F.col("l") % 2 != 0, F.col("l")), F.when(F.col("r") % 2 != 0, F.col("r") - 1)), lambda c: c.isNotNull())))
    inside = asked.select(*keys, "level", "cell").join(kept, ["metric", "level", "cell"]).drop("level", "cell")
    # up to two finest cells on either side of what is surely inside
    edges = rows.withColumn("cell", F.explode(F.array_distinct(F.array(lo - 1, lo, lo + 1, hi - 1, hi, hi + 1))))
    by_score = first(rows, ["metric", "score"]).select("metric", F.col("q").alias("cell"), *like)
    border = edges.select(*keys, "cell").join(by_score, ["metric", "cell"]).drop("cell")
    j = inside.unionByName(border).filter((F.abs(F.col("score") - F.col("like_score")) < band) & ((F.col("ticker") != F.col("like_ticker")) | (F.col("date") != F.col("like_date"))))
    w = Window.partitionBy("ticker", "metric", "date").orderBy("like_date", "like_ticker")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("metric", "ticker", "date", "score", "like_ticker", "like_date", "like_score", "place")


def _moments(wide: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of k columns: k * k numbers come to the driver."""
    k = len(columns)
    row = wide.agg(*[F.avg(c) for c in columns], *[F.covar_samp(a, b) for a in columns for b in columns]).first()
    v = np.array([0.0 if x is None else x for x in row], float)
    return v[:k], v[k:].reshape(k, k)


def multivariate(wide: DataFrame, columns: Sequence[str], contamination: float = 0.05, components: int = 2) -> DataFrame:
    """Rows scored by squared Mahalanobis distance and by reconstruction error
    of the leading principal components; each detector votes for its top share,
    an anomaly has both votes. Rows with nulls take the column's mean."""
    mean, cov = _moments(wide, columns)
    sd = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1))
    corr = cov / np.outer(sd, sd)
    inv = np.linalg.pinv(corr)
    _, vec = np.linalg.eigh(corr)
    rest = np.eye(len(columns)) - vec[:, -components:] @ vec[:, -components:].T
    z = [(F.coalesce(F.col(c), F.lit(float(m))) - float(m)) / float(s) for c, m, s in zip(columns, mean, sd, strict=True)]
    d = wide.withColumns({f"__z{i}": e for i, e in enumerate(z)})
    quad = lambda a: sum((F.col(f"__z{i}") * F.col(f"__z{j}") * float(a[i, j]) for i in range(len(columns)) for j in range(len(columns))), F.lit(0.0))
    d = d.withColumns({"mahalanobis": quad(inv), "reconstruction": quad(rest)}).drop(*[f"__z{i}" for i in range(len(columns))])
    q = d.agg(*[F.percentile(c, F.lit(1 - contamination)).alias(f"q_{c}") for c in ("mahalanobis", "reconstruction")])
    d = d.crossJoin(F.broadcast(q))
    votes = sum(((F.col(c) > F.col(f"q_{c}")).cast("int") for c in ("mahalanobis", "reconstruction")), F.lit(0))
    score = F.array(F.col("mahalanobis"), F.col("reconstruction"))
    spread = F.abs(div(score[0], F.col("q_mahalanobis")) - div(score[1], F.col("q_reconstruction"))) / 2
    return d.withColumns({"votes": votes, "is_anomaly": votes == 2, "confidence": F.greatest(F.lit(0.5), F.least(F.lit(0.99), 1 - spread))}).drop("q_mahalanobis", "q_reconstruction")


def severity_tiers(scored: DataFrame, column: str = "score") -> DataFrame:
    """Severity by the 95, 80 and 50 percentiles of the scores themselves."""
    q = scored.agg(F.percentile(column, F.array(F.lit(0.5), F.lit(0.8), F.lit(0.95))).alias("q"))
    s, x = scored.crossJoin(F.broadcast(q)), F.col(column)
    return s.withColumn("severity", F.when(x > F.col("q")[2], "critical").when(x > F.col("q")[1], "high").when(x > F.col("q")[0], "medium").otherwise("low")).drop("q")


def finite(x: float) -> float | None:
    return x if math.isfinite(x) else None
