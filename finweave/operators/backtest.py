"""Strategies and their backtests on (ticker, date, close)."""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.functions.num import Series, div

S = Series()
YEAR = 252


class Strategy(Protocol):
    """Adds ``signal`` and ``position`` (-1, 0, 1) to bars."""

    def __call__(self, bars: DataFrame) -> DataFrame: ...


def momentum(bars: DataFrame, lookback: int = 20, hold: int = 5) -> DataFrame:
    """Long above the sample's 70 percent quantile of mean return, short below
    the 30 percent one; a signal holds for ``hold`` bars."""
    b = bars.withColumn("ret", S.change("close"))
    b = b.withColumn("momentum", S.mean("ret", lookback))
    q = b.groupBy("ticker").agg(F.percentile("momentum", F.array(F.lit(0.3), F.lit(0.7))).alias("q"))
    b = b.join(q, "ticker")
    signal = F.when(F.col("momentum") > F.col("q")[1], 1).when(F.col("momentum") < F.col("q")[0], -1).otherwise(0)
    b = b.withColumn("signal", signal).drop("q")
    held = F.last(F.nullif(F.col("signal"), F.lit(0)), ignorenulls=True).over(S.w.rowsBetween(-(hold - 1), 0))
    return b.withColumn("position", F.coalesce(held, F.lit(0)))


def mean_reversion(bars: DataFrame, window: int = 20, limit: float = 2.0) -> DataFrame:
    """Short above ``limit`` deviations from the moving mean, long below."""
    b = bars.withColumn("ret", S.change("close"))
    b = b.withColumn("zscore", div(F.col("close") - S.mean("close", window), S.std("close", window)))
    signal = F.when(F.col("zscore") > limit, -1).when(F.col("zscore") < -limit, 1).otherwise(0)
    return b.withColumn("signal", signal).withColumn("position", F.col("signal"))


def run(placed: DataFrame, capital: float = 100_000.0, cost: float = 0.002) -> DataFrame:
    """Returns of yesterday's position less the cost of today's change, and equity."""
    b = placed.withColumns({"trade": F.coalesce(F.abs(F.col("position") - S.lag("position")), F.lit(0)), "gross": F.coalesce(S.lag("position"), F.lit(0)) * F.col("ret")})
    b = b.withColumn("net", F.col("gross") - F.col("trade") * cost)
    b = b.withColumn("equity", S.total(F.product, 1 + F.coalesce(F.col("net"), F.lit(0.0))) * capital)
    b = b.withColumn("peak", S.total(F.max, "equity"))
    return b.withColumn("drawdown", div("equity", "peak") - 1).drop("peak")


def summary(ran: DataFrame, capital: float = 100_000.0, risk_free: float = 0.02, cost: float = 0.002) -> DataFrame:
    """One record per ticker: returns, risk, trading and cost figures."""
    r, t = F.col("net"), F.col("trade") > 0
    base = ran.filter("net is not null").groupBy("ticker").agg(
        F.count(r).alias("n"), F.product(1 + r).alias("growth"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.avg(F.when(r < 0, r * r)).alias("neg2"), F.min("drawdown").alias("dd"),
        F.percentile(r, F.lit(0.05)).alias("q05"), F.sum(t.cast("long")).alias("trades"), F.sum((t & (r > 0)).cast("long")).alias("wins"), F.sum(F.when(t & (r > 0), r)).alias("won"), (-F.sum(F.when(t & (r < 0), r))).alias("lost"),
        F.avg((F.col("position") != 0).cast("double")).alias("time_in_market"), F.sum(F.col("trade") * cost).alias("total_cost"),
    )
    j = ran.filter("net is not null").join(base.select("ticker", "q05"), "ticker").filter(F.col("net") <= F.col("q05"))
    tail = j.groupBy("ticker").agg(F.avg("net").alias("tail"))
    c = F.col
    rf, root = risk_free / YEAR, math.sqrt(YEAR)
    annual = F.pow(c("growth"), F.lit(float(YEAR)) / c("n")) - 1
    return base.join(tail, "ticker", "left").select(
        "ticker",
        (c("growth") - 1).alias("total_return"),
        F.when(c("growth") > 0, annual).alias("annual_return"),
        (c("sd") * root).alias("volatility"),
        (div(c("mean") - rf, "sd") * root).alias("sharpe_ratio"),
        (div(c("mean") - rf, F.sqrt("neg2")) * root).alias("sortino_ratio"),
        (-c("dd")).alias("max_drawdown"),
        div(F.when(c("growth") > 0, annual), -c("dd")).alias("calmar_ratio"),
        (-c("q05")).alias("var_95"),
        (-c("tail")).alias("cvar_95"),
        c("trades"),
        div("wins", "trades").alias("win_rate"),
        div("won", "lost").alias("profit_factor"),
        "time_in_market",
        "total_cost",
        (c("growth") * capital).alias("final_equity"),
    )


def trade_log(ran: DataFrame) -> DataFrame:
    """Closed trades: a run of one position from its first bar to the bar that
    changes it; the last, still open one is not told."""
    b = ran.withColumn("__new", F.coalesce((F.col("position") != S.lag("position")).cast("int"), F.lit(1)))
    b = b.withColumn("__run", S.total(F.sum, "__new"))
    runs = b.groupBy("ticker", "__run").agg(F.min("date").alias("entry_date"), F.min_by("equity", "date").alias("entry_equity"), F.first("position").alias("position"), F.count(F.lit(1)).alias("bars"))
    w = Window.partitionBy("ticker").orderBy("__run")
    t = runs.select("ticker", "position", "entry_date", F.lead("entry_date").over(w).alias("exit_date"), "entry_equity", F.lead("entry_equity").over(w).alias("exit_equity"), "bars")
    t = t.filter("position <> 0 and exit_date is not null")
    return t.withColumns({"trade_return": div("exit_equity", "entry_equity") - 1, "days": F.datediff("exit_date", "entry_date")})


def holding_period(placed: DataFrame) -> DataFrame:
    """Mean length of closed runs in the market, whichever side."""
    b = placed.withColumn("__in", (F.col("position") != 0).cast("int"))
    b = b.withColumn("__new", F.coalesce((F.col("__in") != S.lag("__in")).cast("int"), F.lit(1)))
    b = b.withColumn("__run", S.total(F.sum, "__new"))
    runs = b.groupBy("ticker", "__run").agg(F.max("__in").alias("inside"), F.count(F.lit(1)).alias("n"))
    last = F.max("__run").over(Window.partitionBy("ticker"))
    return runs.withColumn("last", last).groupBy("ticker").agg(F.avg(F.when((F.col("inside") == 1) & (F.col("__run") < F.col("last")), F.col("n"))).alias("avg_holding_period"))


def calendar_returns(returns: DataFrame, unit: str = "month") -> DataFrame:
    """Compounded return of each month, quarter or year."""
    return returns.filter("ret is not null").groupBy("ticker", F.date_trunc(unit, "date").cast("date").alias("period")).agg((F.product(1 + F.col("ret")) - 1).alias("period_return"))


def walk_forward(ran: DataFrame, train: int = 252, test: int = 63, step: int = 21) -> DataFrame:
    """Test windows after each training window: every bar goes to the windows
    that hold it (at most test / step of them), then they aggregate."""
    b = ran.withColumn("i", F.row_number().over(S.w) - 1).withColumn("n", F.count(F.lit(1)).over(S.all))
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") - train - test + 1) / step))
    hi = F.least(F.floor((F.col("i") - train) / step), F.floor((F.col("n") - train - test) / step))
    b = b.filter((F.col("i") >= train) & (lo <= hi)).withColumn("window", F.explode(F.sequence(lo, hi)))
    a = b.groupBy("ticker", "window").agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.count(F.lit(1)).alias("bars"), (F.product(1 + F.coalesce(F.col("net"), F.lit(0.0))) - 1).alias("test_return"), F.avg("net").alias("m"), F.stddev_samp("net").alias("s"))
    return a.withColumn("test_sharpe", div("m", "s") * math.sqrt(YEAR)).drop("m", "s")


def rebalance(target: DataFrame, current: DataFrame, prices: DataFrame, value: float, threshold: float = 0.01) -> DataFrame:
    """Trades from current to target weights (asset, weight) at prices (asset,
    price): those beyond the threshold, whole shares toward zero, none of zero."""
    j = target.withColumnRenamed("weight", "target").join(current.withColumnRenamed("weight", "current"), "asset", "left").na.fill(0.0, ["current"]).join(prices, "asset", "left")
    d = F.col("target") - F.col("current")
    shares = div(d * value, "price")
    n = F.when(shares >= 0, F.floor(shares)).otherwise(F.ceil(shares)).cast("long")
    return j.withColumn("weight_change", d).withColumn("shares", n).filter((F.abs("weight_change") > threshold) & (F.col("shares") != 0))
