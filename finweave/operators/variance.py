"""Period variance, margins, DuPont, working capital and waterfalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.functions import constants as K
from finweave.functions.num import Series, div

KEYS = ("ticker", "fiscal_year")


def favourable(metric: Column, change: Column) -> Column:
    """True or false by the metric's direction; null if it has none."""
    up = [m for m, d in K.FAVOURABLE.items() if d == "increase"]
    down = [m for m, d in K.FAVOURABLE.items() if d == "decrease"]
    return F.when(metric.isin(up), change > 0).when(metric.isin(down), change < 0)


def explanation(metric: Column, pct: Column) -> Column:
    size = F.when(F.abs(pct) < 1, "minimal").when(F.abs(pct) < 5, "slight").when(F.abs(pct) < 10, "moderate").when(F.abs(pct) < 20, "significant").otherwise("substantial")
    way = F.when(pct > 0, "increase").otherwise("decrease")
    return F.concat(metric, F.lit(" shows a "), size, F.lit(" "), way, F.lit(" of "), F.format_string("%.1f", F.abs(pct)), F.lit("%"))


def period_variance(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Two periods of (ticker, metric_name, value): full outer by metric, a
    missing side is 0; percent against the prior's size, ±100 or 0 if it is 0."""
    a = current.select("ticker", "metric_name", F.col("value").alias("current_value"))
    b = prior.select("ticker", "metric_name", F.col("value").alias("prior_value"))
    j = a.join(b, ["ticker", "metric_name"], "full_outer").na.fill(0.0, ["current_value", "prior_value"])
    change = F.col("current_value") - F.col("prior_value")
    pct = F.when(F.col("prior_value") != 0, div(change, F.abs("prior_value")) * 100).otherwise(F.signum("current_value") * 100)
    j = j.withColumn("absolute_change", change).withColumn("percent_change", pct)
    return j.withColumn("is_favorable", favourable(F.col("metric_name"), F.col("absolute_change"))).withColumn("explanation", explanation(F.col("metric_name"), F.col("percent_change")))


def key_drivers(variances: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Metrics that moved by the threshold, ranked by size of change."""
    by = Window.partitionBy("ticker").orderBy(F.abs("absolute_change").desc(), "metric_name")
    return variances.filter(F.abs("percent_change") >= threshold * 100).withColumn("driver_rank", F.row_number().over(by))


def report(variances: DataFrame) -> DataFrame:
    """Formatted strings: amounts, percent and a mark."""
    mark = F.when(F.col("is_favorable"), "✓").when(~F.col("is_favorable"), "✗").otherwise("-")
    return variances.select("ticker", "metric_name", F.format_string("%.2f", "current_value").alias("current"), F.format_string("%.2f", "prior_value").alias("prior"), F.format_string("%.1f%%", "percent_change").alias("change"), mark.alias("mark"))


def _prior(stmt: DataFrame) -> tuple[Series, Column]:
    s = Series(("ticker",), ("fiscal_year",))
    return s, s.lag("fiscal_year") == F.col("fiscal_year") - 1


def margins(stmt: DataFrame) -> DataFrame:
    """Gross, operating and net margin in percent and their change in points."""
    s, before = _prior(stmt)
    names = {"gross_margin": "GrossProfit", "operating_margin": "OperatingIncome", "net_margin": "NetIncome"}
    m = stmt.select(*KEYS, *[(div(x, "Revenue") * 100).alias(n) for n, x in names.items()])
    m = m.select(*KEYS, *names, *[F.when(before, s.lag(n)).alias(f"prior_{n}") for n in names])
    rows = F.stack(F.lit(3), *[x for n in names for x in (F.lit(n), F.col(n), F.col(f"prior_{n}"))]).alias("margin", "current_value", "prior_value")
    r = m.select(*KEYS, rows).filter("prior_value is not null and current_value is not null")
    change = F.col("current_value") - F.col("prior_value")
    pct = F.coalesce(div(change, F.abs("prior_value")) * 100, F.lit(0.0))
    return r.select(*KEYS, "margin", "current_value", "prior_value", change.alias("point_change"), pct.alias("percent_change"), (change > 0).alias("is_favorable"))


def dupont(stmt: DataFrame) -> DataFrame:
    """Change of return on equity split into margin, turnover and leverage;
    the three parts add up to it."""
    s, before = _prior(stmt)
    d = stmt.select(*KEYS, div("NetIncome", "Revenue").alias("npm"), div("Revenue", "Assets").alias("turnover"), div("Assets", "Equity").alias("leverage"))
    d = d.select(*KEYS, "npm", "turnover", "leverage", *[F.when(before, s.lag(x)).alias(f"prior_{x}") for x in ("npm", "turnover", "leverage")])
    d = d.filter("prior_npm is not null")
    roe, prior = F.col("npm") * F.col("turnover") * F.col("leverage"), F.col("prior_npm") * F.col("prior_turnover") * F.col("prior_leverage")
    return d.select(
        *KEYS,
        roe.alias("current_roe"),
        prior.alias("prior_roe"),
        (roe - prior).alias("roe_change"),
        ((F.col("npm") - F.col("prior_npm")) * F.col("prior_turnover") * F.col("prior_leverage")).alias("npm_impact"),
        (F.col("npm") * (F.col("turnover") - F.col("prior_turnover")) * F.col("prior_leverage")).alias("turnover_impact"),
        (F.col("npm") * F.col("turnover") * (F.col("leverage") - F.col("prior_leverage"))).alias("leverage_impact"),
    )


def working_capital(stmt: DataFrame) -> DataFrame:
    """Working capital and its components against the year before."""
    s, before = _prior(stmt)
    items = {"WorkingCapital": F.col("CurrentAssets") - F.col("CurrentLiabilities"), **{m: F.col(m) for m in ("Cash", "AccountsReceivable", "Inventory", "CurrentLiabilities")}}
    w = stmt.select(*KEYS, *[e.alias(n) for n, e in items.items()])
    w = w.select(*KEYS, *items, *[F.when(before, s.lag(n)).alias(f"prior_{n}") for n in items])
    rows = F.stack(F.lit(len(items)), *[x for n in items for x in (F.lit(n), F.col(n), F.col(f"prior_{n}"))]).alias("item", "current_value", "prior_value")
    r = w.select(*KEYS, rows).filter("prior_value is not null")
    change = F.col("current_value") - F.col("prior_value")
    return r.select(*KEYS, "item", "current_value", "prior_value", change.alias("absolute_change"), F.coalesce(div(change, F.abs("prior_value")) * 100, F.lit(0.0)).alias("percent_change"))


def waterfall(variances: DataFrame, start: str = "Revenue", end: str = "NetIncome") -> DataFrame:
    """Steps from the prior start metric to the current end metric; nothing for
    tickers that lack either."""
    ends = variances.filter(F.col("metric_name").isin(start, end)).groupBy("ticker").agg(
        F.max(F.when(F.col("metric_name") == start, F.col("prior_value"))).alias("from"), F.max(F.when(F.col("metric_name") == end, F.col("current_value"))).alias("to")
    ).filter("from is not null and to is not null")
    by = Window.partitionBy("ticker").orderBy(F.abs("absolute_change").desc(), "metric_name")
    moves = variances.filter(~F.col("metric_name").isin(start, end) & (F.abs("absolute_change") > 0.01)).join(ends, "ticker")
    moves = moves.select("ticker", (F.row_number().over(by)).alias("step"), F.col("metric_name").alias("label"), F.col("absolute_change").alias("amount"), (F.col("from") + F.sum("absolute_change").over(by.rowsBetween(Window.unboundedPreceding, 0))).alias("cumulative"))
    first = ends.select("ticker", F.lit(0).alias("step"), F.lit(f"{start} (prior)").alias("label"), F.col("from").alias("amount"), F.col("from").alias("cumulative"))
    last = ends.select("ticker", F.lit(10_000).alias("step"), F.lit(f"{end} (current)").alias("label"), F.col("to").alias("amount"), F.col("to").alias("cumulative"))
    return first.unionByName(moves).unionByName(last)
