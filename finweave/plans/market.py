"""Queries on price bars and macro series."""

from __future__ import annotations

from pyspark.sql import functions as F

from finweave.functions.num import rounded
from finweave.operators import indicators, macro
from finweave.plans.registry import query
from finweave.sources import domain as D

S = D.sql
W = "(PARTITION BY ticker ORDER BY date)"


def full(agg: str, x: str, n: int, part: str = "ticker") -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


def lag(x: str, n: int = 1, part: str = "ticker") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {part} ORDER BY date)"


def pick(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def bars(spark, sf_dir):
    return D.bars(spark, sf_dir)


@query(
    S("bars")
    + f""", p AS (SELECT *, close / nullif({lag("close")}, 0) - 1 AS daily_return, ln(close / nullif({lag("close")}, 0)) AS log_return, high - low AS intraday_range, (high - low) / nullif(close, 0) AS intraday_range_pct,
    open - {lag("close")} AS gap, (open - {lag("close")}) / nullif({lag("close")}, 0) AS gap_pct, volume / nullif({full("avg", "volume", 20)}, 0) AS volume_ratio, volume * close AS dollar_volume FROM bars)
    SELECT ticker, date, {pick("daily_return", "log_return", "intraday_range", "intraday_range_pct", "gap", "gap_pct", "volume_ratio", "dollar_volume", digits=4)} FROM p"""
)
def price_metrics(spark, sf_dir):
    return rounded(indicators.price_metrics(bars(spark, sf_dir)).drop("open", "high", "low", "close", "volume"), 4)


@query(S("bars") + ", p AS (SELECT *, " + ", ".join(f"{full('avg', 'close', n)} AS sma_{n}" for n in (5, 10, 20, 50, 200)) + ") SELECT ticker, date, ".replace(")", " FROM bars)", 1) + pick("sma_5", "sma_10", "sma_20", "sma_50", "sma_200", digits=4) + " FROM p")
def moving_averages(spark, sf_dir):
    return rounded(indicators.moving_averages(bars(spark, sf_dir)).drop("open", "high", "low", "close", "volume"), 4)


def _ema(name: str, src: str, x: str, span: int) -> str:
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"{name} AS (SELECT ticker, i, {x} AS y FROM {src} WHERE i = 1 UNION ALL SELECT s.ticker, s.i, {a} * s.{x} + (1 - {a}) * e.y FROM {name} e JOIN {src} s ON s.ticker = e.ticker AND s.i = e.i + 1)"


@query(
    S("bars")
    + f""", ordered AS (SELECT ticker, date, close, row_number() OVER {W} AS i FROM bars), {_ema("e12", "ordered", "close", 12)}, {_ema("e26", "ordered", "close", 26)}, {_ema("e50", "ordered", "close", 50)},
    m AS (SELECT o.*, a.y AS ema_12, b.y AS ema_26, c.y AS ema_50, a.y - b.y AS macd FROM ordered o JOIN e12 a USING (ticker, i) JOIN e26 b USING (ticker, i) JOIN e50 c USING (ticker, i)), {_ema("sig", "m", "macd", 9)}
    SELECT m.ticker, date, round(ema_12, 3) AS ema_12, round(ema_26, 3) AS ema_26, round(ema_50, 3) AS ema_50, round(macd, 3) AS macd, round(sig.y, 3) AS macd_signal, round(macd - sig.y, 3) AS macd_hist FROM m JOIN sig USING (ticker, i)"""
)
def ema_macd(spark, sf_dir):
    return rounded(indicators.ewm(bars(spark, sf_dir)), 3)


@query(
    S("bars")
    + f""", d AS (SELECT *, close - {lag("close")} AS d FROM bars), g AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS loss FROM d),
    m AS (SELECT ticker, date, {full("avg", "gain", 14)} AS g, {full("avg", "loss", 14)} AS l FROM g) SELECT ticker, date, round(CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END, 6) AS rsi_14 FROM m"""
)
def rsi(spark, sf_dir):
    return rounded(indicators.rsi(bars(spark, sf_dir)).select("ticker", "date", "rsi_14"))


@query(
    S("bars")
    + f""", m AS (SELECT *, {full("avg", "close", 20)} AS bb_middle, {full("stddev_samp", "close", 20)} AS sd FROM bars), b AS (SELECT *, bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower FROM m)
    SELECT ticker, date, {pick("bb_middle", "bb_upper", "bb_lower", digits=3)}, round(bb_upper - bb_lower, 3) AS bb_width, round((close - bb_lower) / nullif(bb_upper - bb_lower, 0), 6) AS bb_pct FROM b"""
)
def bollinger_bands(spark, sf_dir):
    b = indicators.bollinger(bars(spark, sf_dir)).select("ticker", "date", "bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_pct")
    return rounded(b, 3, bb_pct=6)


_TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


@query(
    S("bars")
    + f""", t AS (SELECT *, {_TR} AS tr, coalesce(sign(close - {lag("close")}) * volume, 0) AS v FROM bars)
    SELECT ticker, date, round({full("avg", "tr", 14)}, 3) AS atr_14, CAST(sum(v) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS obv FROM t"""
)
def atr_obv(spark, sf_dir):
    return rounded(indicators.obv(indicators.atr(bars(spark, sf_dir))).select("ticker", "date", "atr_14", "obv"), 3)


@query(
    S("bars")
    + f""", t AS (SELECT *, {_TR} AS tr, greatest(high - {lag("high")}, 0) AS u, greatest({lag("low")} - low, 0) AS d, row_number() OVER {W} = 1 AS first FROM bars),
    p AS (SELECT ticker, date, tr, CASE WHEN first THEN 0.0 WHEN u > d THEN u ELSE 0.0 END AS p, CASE WHEN first THEN 0.0 WHEN d >= u THEN d ELSE 0.0 END AS m FROM t),
    s AS (SELECT ticker, date, {full("avg", "tr", 14)} AS tr, {full("avg", "p", 14)} AS p, {full("avg", "m", 14)} AS m FROM p),
    i AS (SELECT ticker, date, p * 100 / nullif(tr, 0) AS plus_di, m * 100 / nullif(tr, 0) AS minus_di FROM s), x AS (SELECT *, abs(plus_di - minus_di) * 100 / nullif(plus_di + minus_di, 0) AS dx FROM i)
    SELECT ticker, date, round(plus_di, 5) AS plus_di, round(minus_di, 5) AS minus_di, round({full("avg", "dx", 14)}, 5) AS adx FROM x"""
)
def adx(spark, sf_dir):
    return rounded(indicators.adx(bars(spark, sf_dir)).select("ticker", "date", "plus_di", "minus_di", "adx"), 5)


@query(
    S("bars")
    + f""", t AS (SELECT ticker, date, (close - {full("min", "low", 14)}) * 100 / nullif({full("max", "high", 14)} - {full("min", "low", 14)}, 0) AS k FROM bars),
    s AS (SELECT ticker, date, {full("avg", "k", 3)} AS stoch_k FROM t) SELECT ticker, date, round(stoch_k, 6) AS stoch_k, round({full("avg", "stoch_k", 3)}, 6) AS stoch_d FROM s"""
)
def stochastic(spark, sf_dir):
    return rounded(indicators.stochastic(bars(spark, sf_dir)).select("ticker", "date", "stoch_k", "stoch_d"))


@query(S("bars") + f" SELECT ticker, date, {full('min', 'low', 20)} AS support, {full('max', 'high', 20)} AS resistance FROM bars")
def support_resistance(spark, sf_dir):
    return indicators.support_resistance(bars(spark, sf_dir)).select("ticker", "date", "support", "resistance")


@query(
    S("bars")
    + ", p AS (SELECT ticker, date, "
    + ", ".join(f"close / nullif({lag('close', n)}, 0) - 1 AS return_{n}d, ln(close / nullif({lag('close', n)}, 0)) AS log_return_{n}d" for n in (1, 5, 10, 20, 60, 120, 252))
    + ", "
    + ", ".join(f"lead(close, {n}) OVER {W} / nullif(close, 0) - 1 AS forward_return_{n}d" for n in (1, 5, 10, 20))
    + " FROM bars) SELECT ticker, date, round(COLUMNS(* EXCLUDE (ticker, date)), 6) FROM p"
)
def return_panel(spark, sf_dir):
    return rounded(indicators.returns(bars(spark, sf_dir)).drop("open", "high", "low", "close", "volume"))


@query(
    S("bars")
    + f""", p AS (SELECT ticker, date, close / nullif({lag("close")}, 0) - 1 AS r, ln(high / nullif(low, 0)) * ln(high / nullif(low, 0)) AS p, 0.5 * ln(high / nullif(low, 0)) * ln(high / nullif(low, 0)) - (2 * ln(2) - 1) * ln(close / nullif(open, 0)) * ln(close / nullif(open, 0)) AS g FROM bars),
    v AS (SELECT ticker, date, """
    + ", ".join(f"{full('stddev_samp', 'r', n)} * sqrt(252) AS volatility_{n}d, sqrt({full('sum', 'p', n)} * (252 / (4 * {n} * ln(2)))) AS parkinson_{n}d, {full('sum', 'g', n)} * (252.0::DOUBLE / {n}) AS gk{n}" for n in (10, 20, 30, 60))
    + " FROM p) SELECT ticker, date, "
    + ", ".join(f"round(volatility_{n}d, 6) AS volatility_{n}d, round(parkinson_{n}d, 6) AS parkinson_{n}d, round(CASE WHEN gk{n} >= 0 THEN sqrt(gk{n}) END, 6) AS garman_klass_{n}d" for n in (10, 20, 30, 60))
    + " FROM v"
)
def volatility(spark, sf_dir):
    return rounded(indicators.volatility(bars(spark, sf_dir)).drop("open", "high", "low", "close", "volume"))


@query(
    S("bars")
    + f""", ordered AS (SELECT ticker, date, close, row_number() OVER {W} AS i FROM bars), {_ema("e12", "ordered", "close", 12)}, {_ema("e26", "ordered", "close", 26)},
    mc AS (SELECT o.*, a.y - b.y AS macd FROM ordered o JOIN e12 a USING (ticker, i) JOIN e26 b USING (ticker, i)), {_ema("sig", "mc", "macd", 9)},
    x AS (SELECT mc.ticker, mc.date, macd > sig.y AS above FROM mc JOIN sig USING (ticker, i)), crossed AS (SELECT ticker, date, above AND NOT {lag("above")} AS up FROM x),
    m AS (SELECT *, {full("avg", "close", 20)} AS sma_20, {full("avg", "close", 50)} AS sma_50, {full("avg", "close", 200)} AS sma_200, {full("avg", "volume", 20)} AS volume_sma_20, close - {lag("close")} AS d FROM bars),
    g AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS loss FROM m), h AS (SELECT *, {full("avg", "gain", 14)} AS ag, {full("avg", "loss", 14)} AS al FROM g),
    r AS (SELECT *, CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100 END AS rsi FROM h),
    f AS (SELECT ticker, date, {", ".join(f"round(close / nullif(sma_{n}, 0) - 1, 6) AS price_to_sma_{n}" for n in (20, 50, 200))}, round((sma_20 - {lag("sma_20", 5)}) / nullif({lag("sma_20", 5)}, 0), 6) AS sma_20_trend,
    round((sma_50 - {lag("sma_50", 10)}) / nullif({lag("sma_50", 10)}, 0), 6) AS sma_50_trend, round((volume_sma_20 - {lag("volume_sma_20", 5)}) / nullif({lag("volume_sma_20", 5)}, 0), 6) AS volume_trend, CAST(coalesce(rsi < 30, false) AS INTEGER) AS rsi_oversold, CAST(coalesce(rsi > 70, false) AS INTEGER) AS rsi_overbought,
    CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter FROM r)
    SELECT f.*, CAST(coalesce(up, false) AS INTEGER) AS macd_cross_up FROM f JOIN crossed USING (ticker, date)"""
)
def ml_features(spark, sf_dir):
    f = indicators.ml_features(bars(spark, sf_dir))
    return rounded(f.select("ticker", "date", "price_to_sma_20", "price_to_sma_50", "price_to_sma_200", "sma_20_trend", "sma_50_trend", "volume_trend", "rsi_oversold", "rsi_overbought", "macd_cross_up", "day_of_week", "month", "quarter"))


# Macro -------------------------------------------------------------------


def _macro(spark, sf_dir):
    return D.macro(spark, sf_dir)


@query(
    S("macro")
    + ", p AS (SELECT series_id, date, "
    + ", ".join(f"value - {lag('value', n, 'series_id')} AS change_{n}d" for n in (1, 5, 21))
    + ", "
    + ", ".join(f"CASE WHEN NOT regexp_matches(series_id, 'rate|spread|ratio') THEN (value / nullif({lag('value', n, 'series_id')}, 0) - 1) * 100 END AS pct_change_{n}d" for n in (5, 21))
    + ", "
    + ", ".join(f"{full('avg', 'value', n, 'series_id')} AS ma_{n}d" for n in (5, 10))
    + f", (value - {full('avg', 'value', 10, 'series_id')}) / nullif({full('stddev_samp', 'value', 10, 'series_id')}, 0) AS zscore FROM macro) SELECT series_id, date, round(COLUMNS(* EXCLUDE (series_id, date)), 6) FROM p"
)
def macro_changes(spark, sf_dir):
    return rounded(macro.changes(_macro(spark, sf_dir), (1, 5, 21), (5, 21), (5, 10)).drop("value"))


@query(
    S("macro")
    + f""", p AS (SELECT series_id, date, value, value / nullif({lag("value", 1, "series_id")}, 0) - 1 AS r, value - {lag("value", 5, "series_id")} AS change_5, {full("avg", "value", 5, "series_id")} AS ma_5, {full("avg", "value", 10, "series_id")} AS ma_10,
    {full("stddev_samp", "value", 10, "series_id")} AS sd FROM macro), q AS (SELECT *, {full("stddev_samp", "r", 5, "series_id")} AS vol_5, (value - ma_10) / nullif(sd, 0) AS zscore_10 FROM p)
    SELECT series_id, date, round(value, 6) AS value, round(change_5, 6) AS change_5, round(ma_5, 6) AS ma_5, round(ma_10, 6) AS ma_10, round(vol_5, 6) AS vol_5, round(zscore_10, 6) AS zscore_10 FROM q WHERE date <= DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) = 1"""
)
def macro_features_at(spark, sf_dir):
    return rounded(macro.features_at(_macro(spark, sf_dir), "2024-01-20", (5,), (5, 10), 5))


_IDS = ("click", "error", "purchase", "signup", "view")


@query(
    S("macro")
    + ", w AS (SELECT date, "
    + ", ".join(f"min(value) FILTER (series_id = '{i}' AND day(date) % 3 <> {k % 3}) AS {i}" for k, i in enumerate(_IDS))
    + " FROM macro GROUP BY date) SELECT date, "
    + ", ".join(f"last_value({i} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS {i}" for i in _IDS)
    + " FROM w"
)
def macro_wide(spark, sf_dir):
    k = F.array_position(F.array(*[F.lit(i) for i in _IDS]), F.col("series_id")) - 1
    gaps = _macro(spark, sf_dir).withColumn("value", F.when(F.day("date") % 3 != k % 3, F.col("value")))
    return macro.wide(gaps, _IDS)


@query(
    S("macro")
    + ", z AS (SELECT date, series_id, (value - avg(value) OVER (PARTITION BY series_id)) / nullif(stddev_samp(value) OVER (PARTITION BY series_id), 0) AS z FROM macro) SELECT date, round(avg(z), 6) AS composite FROM z GROUP BY date"
)
def financial_conditions(spark, sf_dir):
    w = macro.wide(_macro(spark, sf_dir), _IDS, fill=False)
    return rounded(macro.composite(w, _IDS).select("date", "composite"))


@query(S("macro") + " SELECT series_id, max(date) AS date, arg_max(value, date) AS value FROM macro GROUP BY 1")
def nowcast_latest(spark, sf_dir):
    return macro.nowcast(_macro(spark, sf_dir))


@query(
    """WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
    SELECT p.event_id, p.user_id, p.ts, p.value, v.value AS last_view FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"""
)
def as_of_join(spark, sf_dir):
    e = D.read(spark, sf_dir, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    return macro.as_of(left, right, ["user_id"], "ts", ["last_view"])
