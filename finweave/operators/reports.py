"""Reports: figures as text, sorted by number and formatted last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.functions.num import div


def currency(value: Column, code: str = "USD", digits: int = 2) -> Column:
    """ "USD 1,234.00"; a dash for null and NaN, "inf" for infinity. Zero has no sign."""
    v = F.nanvl(value.cast("double"), F.lit(None)) + F.lit(0.0)
    told = F.when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").otherwise(F.format_number(v, digits))
    return F.coalesce(F.concat(F.lit(f"{code} "), told), F.lit("-"))


def percent(value: Column, digits: int = 1) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f%%", value * 100), F.lit("-"))


def plain(value: Column, digits: int = 3) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", value), F.lit("-"))


def benchmark(rows: DataFrame) -> DataFrame:
    """Company, median and distance per metric, best percentile first."""
    gap = div(F.col("company_value") - F.col("peer_median"), F.abs("peer_median"))
    r = rows.select("ticker", "metric_name", plain(F.col("company_value")).alias("company"), plain(F.col("peer_median")).alias("median"), percent(gap).alias("vs_median"), F.format_string("%.1f", "percentile_rank").alias("percentile"), "relative_performance", F.col("percentile_rank").alias("__p"))
    return r.orderBy("ticker", F.desc("__p"), "metric_name").drop("__p")


RISK_ROWS = (
    ("Value at Risk (95%)", "var_95", "percent", "Tail risk"),
    ("Value at Risk (99%)", "var_99", "percent", "Tail risk"),
    ("Expected Shortfall (95%)", "cvar_95", "percent", "Tail risk"),
    ("Maximum Drawdown", "max_drawdown", "percent", "Drawdown"),
    ("Volatility", "volatility", "percent", "Spread"),
    ("Downside Deviation", "downside_deviation", "percent", "Spread"),
    ("Sharpe Ratio", "sharpe_ratio", "plain", "Return"),
    ("Sortino Ratio", "sortino_ratio", "plain", "Return"),
    ("Calmar Ratio", "calmar_ratio", "plain", "Return"),
    ("Omega Ratio", "omega_ratio", "plain", "Return"),
)
BACKTEST_ROWS = (
    ("Total Return", "total_return", "percent", "Returns"),
    ("Annual Return", "annual_return", "percent", "Returns"),
    ("Sharpe Ratio", "sharpe_ratio", "plain", "Risk"),
    ("Maximum Drawdown", "max_drawdown", "percent", "Risk"),
    ("Value at Risk (95%)", "var_95", "percent", "Risk"),
    ("Win Rate", "win_rate", "percent", "Trading"),
    ("Profit Factor", "profit_factor", "plain", "Trading"),
    ("Time in Market", "time_in_market", "percent", "Trading"),
    ("Final Equity", "final_equity", "currency", "Capital"),
)
FORMATS = {"percent": lambda c: percent(c, 2), "plain": plain, "currency": currency}


def figures(rows: DataFrame, lines: tuple[tuple[str, str, str, str], ...]) -> DataFrame:
    """Metric, value and category of each line, in order."""
    items = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(n).alias("metric"), FORMATS[k](F.col(c)).alias("value"), F.lit(cat).alias("category")) for i, (n, c, k, cat) in enumerate(lines)])
    return rows.select("ticker", F.explode(items).alias("x")).select("ticker", "x.*")


def sentiment(rows: DataFrame) -> DataFrame:
    """A document's sentiment (mean_sentiment, volatility, trend) in words."""
    m, v, t = F.col("mean_sentiment"), F.col("volatility"), F.col("trend")
    return rows.select(
        "document_id",
        F.when(m > 0.1, "Positive").when(m < -0.1, "Negative").otherwise("Neutral").alias("overall"),
        F.when(v > 0.2, "High").otherwise("Low").alias("volatility"),
        F.when(t > 0, "Improving").when(t < 0, "Declining").otherwise("Stable").alias("trend"),
    )


def collection(chunks: DataFrame) -> DataFrame:
    """Counts of a chunk store (document_id, text flags): rows, documents, share of flags."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("document_id").alias("documents"), (F.avg(F.col("has_financial_data").cast("double")) * 100).alias("financial_percent"), (F.avg(F.col("has_risk_mention").cast("double")) * 100).alias("risk_percent"), F.avg("char_count").alias("mean_chars"))
