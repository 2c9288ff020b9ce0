"""Technical indicators, returns and volatility of price bars (ticker, date,
open, high, low, close, volume). Schemas are static: where a window is not yet
full the value is null."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finweave.functions.num import Series, div, log

S = Series()
BARS = ("ticker", "date")


def price_metrics(bars: DataFrame) -> DataFrame:
    """Returns, ranges, gaps and volume measures."""
    c = F.col
    gap = c("open") - S.lag("close")
    return bars.select(
        "*",
        S.change("close").alias("daily_return"),
        log(div("close", S.lag("close"))).alias("log_return"),
        (c("high") - c("low")).alias("intraday_range"),
        div(c("high") - c("low"), "close").alias("intraday_range_pct"),
        gap.alias("gap"),
        div(gap, S.lag("close")).alias("gap_pct"),
        div("volume", S.mean("volume", 20)).alias("volume_ratio"),
        (c("volume") * c("close")).alias("dollar_volume"),
    )


def moving_averages(bars: DataFrame, periods: Sequence[int] = (5, 10, 20, 50, 200)) -> DataFrame:
    return bars.select("*", *[S.mean("close", n).alias(f"sma_{n}") for n in periods])


def rsi_expr(n: int = 14) -> tuple[Column, Column]:
    """Gain and loss columns; the first bar counts as no move."""
    d = S.diff("close")
    return F.when(d > 0, d).otherwise(0.0), F.when(d < 0, -d).otherwise(0.0)


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength by simple means: 100 without losses, null without any move."""
    gain, loss = rsi_expr(n)
    b = bars.withColumns({"__g": gain, "__l": loss})
    b = b.withColumns({"__g": S.mean("__g", n), "__l": S.mean("__l", n)})
    v = F.when(F.col("__l") > 0, 100 - 100 / (1 + F.col("__g") / F.col("__l"))).when(F.col("__g") > 0, 100.0)
    return b.withColumn(f"rsi_{n}", v).drop("__g", "__l")


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    b = bars.withColumns({"bb_middle": S.mean("close", n), "__sd": S.std("close", n)})
    b = b.withColumns({"bb_upper": F.col("bb_middle") + k * F.col("__sd"), "bb_lower": F.col("bb_middle") - k * F.col("__sd")})
    width = F.col("bb_upper") - F.col("bb_lower")
    return b.withColumns({"bb_width": width, "bb_pct": div(F.col("close") - F.col("bb_lower"), width)}).drop("__sd")


def true_range() -> Column:
    prior = S.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    b = bars.withColumn("__tr", true_range())
    return b.withColumn(f"atr_{n}", S.mean("__tr", n)).drop("__tr")


def obv(bars: DataFrame) -> DataFrame:
    b = bars.withColumn("__v", F.coalesce(F.signum(S.diff("close")) * F.col("volume"), F.lit(0.0)))
    return b.withColumn("obv", S.total(F.sum, "__v")).drop("__v")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Directional movement: of two positive moves the larger counts, on ties the lower."""
    up = F.greatest(S.diff("high"), F.lit(0.0))
    down = F.greatest(-S.diff("low"), F.lit(0.0))
    b = bars.withColumns({"__u": up, "__d": down, "__tr": true_range()})
    first = F.col("__u").isNull() | F.col("__d").isNull()
    plus = F.when(F.col("__u") > F.col("__d"), F.col("__u")).otherwise(0.0)
    minus = F.when(F.col("__d") >= F.col("__u"), F.col("__d")).otherwise(0.0)
    b = b.withColumns({"__p": F.when(first, 0.0).otherwise(plus), "__m": F.when(first, 0.0).otherwise(minus)})
    b = b.withColumns({"__p": S.mean("__p", n), "__m": S.mean("__m", n), "__tr": S.mean("__tr", n)})
    b = b.withColumns({"plus_di": div(F.col("__p") * 100, "__tr"), "minus_di": div(F.col("__m") * 100, "__tr")})
    b = b.withColumn("__dx", div(F.abs(F.col("plus_di") - F.col("minus_di")) * 100, F.col("plus_di") + F.col("minus_di")))
    return b.withColumn("adx", S.mean("__dx", n)).drop("__u", "__d", "__tr", "__p", "__m", "__dx")


def stochastic(bars: DataFrame, n: int = 14, smooth_k: int = 3, smooth_d: int = 3) -> DataFrame:
    b = bars.withColumns({"__lo": S.roll(F.min, "low", n), "__hi": S.roll(F.max, "high", n)})
    b = b.withColumn("__k", div((F.col("close") - F.col("__lo")) * 100, F.col("__hi") - F.col("__lo")))
    b = b.withColumn("stoch_k", S.mean("__k", smooth_k))
    return b.withColumn("stoch_d", S.mean("stoch_k", smooth_d)).drop("__lo", "__hi", "__k")


def support_resistance(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumns({"support": S.roll(F.min, "low", n), "resistance": S.roll(F.max, "high", n)})


def ewm(bars: DataFrame, spans: Sequence[int] = (12, 26, 50), macd: tuple[int, int, int] = (12, 26, 9)) -> DataFrame:
    """Exponential means (recursive, unadjusted) and MACD. A recursion over a
    series needs its rows in order in one place: one grouped pandas step per
    ticker, on (date, close) alone, joined to nothing."""
    names = [f"ema_{n}" for n in spans] + ["macd", "macd_signal", "macd_hist"]
    kind = T.StructType([bars.schema["ticker"], bars.schema["date"], *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        mean = lambda x, n: x.ewm(span=n, adjust=False).mean()
        for n in spans:
            pdf[f"ema_{n}"] = mean(pdf["close"], n)
        pdf["macd"] = mean(pdf["close"], macd[0]) - mean(pdf["close"], macd[1])
        pdf["macd_signal"] = mean(pdf["macd"], macd[2])
        pdf["macd_hist"] = pdf["macd"] - pdf["macd_signal"]
        return pdf[["ticker", "date", *names]]

    return bars.select("ticker", "date", "close").groupBy("ticker").applyInPandas(run, kind)


GROUPS = {"sma": moving_averages, "rsi": rsi, "bollinger": bollinger, "atr": atr, "obv": obv, "adx": adx, "stochastic": stochastic, "support_resistance": support_resistance}


def indicators(bars: DataFrame, groups: Sequence[str] = ("sma", "ema", "rsi", "macd", "bollinger", "atr", "obv", "adx", "stochastic")) -> DataFrame:
    """The named groups together; ema and macd share one grouped step."""
    out = bars
    for g in groups:
        if g in GROUPS:
            out = GROUPS[g](out)
        elif g not in ("ema", "macd"):
            raise ValueError(f"unknown indicator {g}")
    return out.join(ewm(bars), ["ticker", "date"]) if {"ema", "macd"} & set(groups) else out


def returns(bars: DataFrame, periods: Sequence[int] = (1, 5, 10, 20, 60, 120, 252), ahead: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Simple and log returns over past periods, and those ahead."""
    out = [x for n in periods for x in (S.change("close", n).alias(f"return_{n}d"), log(div("close", S.lag("close", n))).alias(f"log_return_{n}d"))]
    return bars.select("*", *out, *[(div(S.lead("close", n), "close") - 1).alias(f"forward_return_{n}d") for n in ahead])


def volatility(bars: DataFrame, windows: Sequence[int] = (10, 20, 30, 60), year: int = 252) -> DataFrame:
    """Close-to-close, Parkinson and Garman-Klass volatility, annualised."""
    hl, co = log(div("high", "low")), log(div("close", "open"))
    b = bars.withColumns({"__r": S.change("close"), "__p": hl * hl, "__g": 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co})
    cols = {}
    for n in windows:
        gk = S.roll(F.sum, "__g", n) * (year / n)
        cols[f"volatility_{n}d"] = S.std("__r", n) * math.sqrt(year)
        cols[f"parkinson_{n}d"] = F.sqrt(S.roll(F.sum, "__p", n) * (year / (4 * n * math.log(2))))
        cols[f"garman_klass_{n}d"] = F.when(gk >= 0, F.sqrt(gk))
    return b.withColumns(cols).drop("__r", "__p", "__g")


def ml_features(bars: DataFrame) -> DataFrame:
    """Indicators, returns and volatility with the price's distance from its
    means, trends, flags (0 where their window is not full) and calendar parts."""
    b = volatility(returns(indicators(bars, ("sma", "rsi", "macd", "ema"))))
    c = F.col
    b = b.withColumn("volume_sma_20", S.mean("volume", 20))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    cross = (c("macd") > c("macd_signal")) & (S.lag("macd") <= S.lag("macd_signal"))
    return b.withColumns(
        {
            **{f"price_to_sma_{n}": div("close", f"sma_{n}") - 1 for n in (20, 50, 200)},
            "sma_20_trend": div(S.diff("sma_20", 5), S.lag("sma_20", 5)),
            "sma_50_trend": div(S.diff("sma_50", 10), S.lag("sma_50", 10)),
            "volume_trend": div(S.diff("volume_sma_20", 5), S.lag("volume_sma_20", 5)),
            "rsi_oversold": flag(c("rsi_14") < 30),
            "rsi_overbought": flag(c("rsi_14") > 70),
            "macd_cross_up": flag(cross),
            "day_of_week": F.weekday("date"),
            "month": F.month("date"),
            "quarter": F.quarter("date"),
        }
    )
