"""Peer groups, benchmarks and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.functions import constants as K
from finweave.functions.num import div, percent_rank_avg


def by_sic(companies: DataFrame, sic: str, most: int = 20, enough: int = 5) -> DataFrame:
    """The exact code's companies; its 3-digit and then 2-digit prefix where
    there are fewer than ``enough``. First by ticker."""
    n = lambda k: F.sum(F.col("sic_code").startswith(sic[:k]).cast("long"))
    counts = companies.agg(n(4).alias("n4"), n(3).alias("n3"))
    level = F.when(F.col("n4") >= enough, 4).when(F.col("n3") >= enough, 3).otherwise(2)
    met = companies.filter(F.col("sic_code").startswith(sic[:2])).crossJoin(F.broadcast(counts.select(level.alias("digits"))))
    return met.filter(F.col("sic_code").startswith(F.substring(F.lit(sic), F.lit(1), F.col("digits")))).orderBy("ticker").limit(most).select("ticker", "name", "sector", "industry", "market_cap", "sic_code")


def by_market_cap(companies: DataFrame, cap: float, sector: str | None = None, tolerance: float = 0.5, most: int = 20) -> DataFrame:
    """Companies in the closed band around a market cap, most similar first."""
    c = companies.filter(F.col("market_cap").between(cap * (1 - tolerance), cap * (1 + tolerance)))
    if sector is not None:
        c = c.filter(F.col("sector") == sector)
    return c.withColumn("similarity_score", 1 - F.abs(F.col("market_cap") - cap) / cap).orderBy(F.desc("similarity_score"), "ticker").limit(most)


def by_fundamentals(target: dict[str, float], metrics: DataFrame, weights: dict[str, float] | None = None, most: int = 20) -> DataFrame:
    """Weighted closeness of z-scores to the target's; a metric without
    spread counts as equal, a missing value as nothing."""
    weights = {m: w for m, w in (weights or K.SIMILARITY_WEIGHTS).items() if m in target and m in metrics.columns}
    stats = metrics.agg(*[x for m in weights for x in (F.avg(m).alias(f"avg_{m}"), F.stddev_samp(m).alias(f"std_{m}"))])
    j = metrics.crossJoin(F.broadcast(stats))
    score: Column = F.lit(0.0)
    for m, w in weights.items():
        gap = F.coalesce(div(F.abs(F.col(m) - target[m]), F.col(f"std_{m}")), F.lit(0.0))
        score = score + F.when(F.col(m).isNotNull(), F.lit(w) / (1 + gap)).otherwise(0.0)
    return j.withColumn("similarity_score", score).orderBy(F.desc("similarity_score"), "ticker").limit(most).select(*metrics.columns, "similarity_score")


def comparison(ratios: DataFrame, companies: DataFrame, ticker: str, fiscal_year: int, names: list[str], most: int = 10) -> DataFrame:
    """A company and up to ``most`` others of its sector with the percent rank
    of each ratio. companies: ticker, sector."""
    own = companies.filter(F.col("ticker") == ticker).select(F.col("sector").alias("own_sector")).limit(1)
    others = companies.join(own, F.col("sector") == F.col("own_sector")).filter(F.col("ticker") != ticker).select("ticker").distinct().orderBy("ticker").limit(most)
    group = others.union(companies.filter(F.col("ticker") == ticker).select("ticker").distinct())
    rows = ratios.filter(F.col("fiscal_year") == fiscal_year).join(group, "ticker", "left_semi")
    return rows.select("ticker", "fiscal_year", *names, *[percent_rank_avg(n).alias(f"{n}_percentile") for n in names])


def tier(percentile: Column) -> Column:
    return F.when(percentile >= 75, "Top Quartile").when(percentile >= 50, "Above Median").when(percentile >= 25, "Below Median").otherwise("Bottom Quartile")


def benchmark(company: DataFrame, peers: DataFrame) -> DataFrame:
    """Company values (ticker, metric_name, value) against the peers' values
    of the same metric (peer_group rows: metric_name, value)."""
    c = company.select("ticker", "metric_name", F.col("value").alias("company_value")).filter("company_value is not null")
    p = peers.select(F.col("ticker").alias("peer"), "metric_name", "value").filter("value is not null")
    j = c.join(p, "metric_name").filter(F.col("peer") != F.col("ticker"))
    x = F.col("value")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = j.groupBy("ticker", "metric_name", "company_value").agg(
        q.alias("q"), F.avg(x).alias("peer_mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("peer_min"), F.max(x).alias("peer_max"),
        (F.avg((x < F.col("company_value")).cast("double")) * 100).alias("percentile_rank"), F.count(x).alias("peer_count"),
    )
    z = F.coalesce(div(F.col("company_value") - F.col("peer_mean"), "std"), F.lit(0.0))
    return a.select("ticker", "metric_name", "company_value", F.col("q")[1].alias("peer_median"), "peer_mean", "peer_min", "peer_max", F.col("q")[0].alias("peer_q1"), F.col("q")[2].alias("peer_q3"), "percentile_rank", z.alias("z_score"), tier(F.col("percentile_rank")).alias("relative_performance"), "peer_count")


def composite(benchmarks: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of percentiles over all weights; 50 without any."""
    if weights is None:
        return benchmarks.groupBy("ticker").agg(F.coalesce(F.avg("percentile_rank"), F.lit(50.0)).alias("composite_score"))
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("metric_name")]
    return benchmarks.groupBy("ticker").agg((F.coalesce(F.sum(F.col("percentile_rank") * w), F.lit(0.0)) / sum(weights.values())).alias("composite_score"))


def strengths(benchmarks: DataFrame, threshold: float = 25.0) -> DataFrame:
    """Metrics at either end of the peers, ranked."""
    p = F.col("percentile_rank")
    kind = F.when(p >= 100 - threshold, "strength").when(p <= threshold, "weakness")
    b = benchmarks.withColumn("kind", kind).filter("kind is not null").withColumn("vs_median", div(F.col("company_value") - F.col("peer_median"), F.abs("peer_median")) * 100)
    by = Window.partitionBy("ticker", "kind").orderBy(F.when(F.col("kind") == "strength", -p).otherwise(p), "metric_name")
    return b.select("ticker", "kind", F.row_number().over(by).alias("place"), "metric_name", "percentile_rank", "vs_median")


def spider(benchmarks: DataFrame) -> DataFrame:
    """Company over median, 50 at par, at most 100; 50 if the median is 0."""
    v = F.coalesce(F.least(F.lit(100.0), div("company_value", "peer_median") * 50), F.lit(50.0))
    return benchmarks.select("ticker", "metric_name", v.alias("radius"))


def sic_industry(code: Column) -> Column:
    """The industry whose closed range holds a code."""
    n = code.try_cast("int")
    out = F.lit(None).cast("string")
    for industry, ranges in reversed(K.SIC_RANGES.items()):
        for lo, hi in ranges:
            out = F.when(n.between(lo, hi), industry).otherwise(out)
    return out
