"""Queries on return series: risk, strategies, anomalies, factors, portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from finweave.functions import constants as K
from finweave.functions import num
from finweave.functions.num import norm_ppf, rounded
from finweave.operators import backtest, risk
from finweave.operators.indicators import S as SERIES
from finweave.plans.market import W, full, lag
from finweave.plans.registry import query
from finweave.sources import domain as D

S = D.sql


def returns(spark, sf_dir):
    return D.bars(spark, sf_dir).select("ticker", "date", SERIES.change("close").alias("ret"))


def calm_bars(spark, sf_dir):
    """Bars whose prices move by a few percent, as strategies need them."""
    return D.bars(spark, sf_dir).withColumn("close", 1000 + F.col("close") / 1000)


def calm_returns(spark, sf_dir):
    return calm_bars(spark, sf_dir).select("ticker", "date", SERIES.change("close").alias("ret"))


_RET = S("bars") + f", rets AS (SELECT ticker, date, close, close / nullif({lag('close')}, 0) - 1 AS ret FROM bars)"
_CALM = S("bars") + f", calm AS (SELECT ticker, date, 1000 + close / 1000 AS close FROM bars), rets AS (SELECT ticker, date, close, close / nullif({lag('close')}, 0) - 1 AS ret FROM calm)"
_GROWTH = f", grown AS (SELECT *, exp(sum(ln(1 + coalesce(ret, 0))) OVER {W}) AS growth FROM rets), peaked AS (SELECT *, max(growth) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM grown)"


@query(_RET + _GROWTH + " SELECT ticker, date, round(growth, 5) AS growth, round(peak, 5) AS peak, round(growth / peak - 1, 6) AS drawdown FROM peaked")
def drawdown_curve(spark, sf_dir):
    return rounded(risk.drawdowns(returns(spark, sf_dir)).select("ticker", "date", "growth", "peak", "drawdown"), growth=5, peak=5)


_Z95, _Z99 = norm_ppf(0.05), norm_ppf(0.01)


def _cf(z: float) -> str:
    return f"-(mean + sd0 * ({z}::DOUBLE + ({z}::DOUBLE ^ 2 - 1) * skew / 6 + ({z}::DOUBLE ^ 3 - 3 * {z}::DOUBLE) * kurt / 24 - (2 * {z}::DOUBLE ^ 3 - 5 * {z}::DOUBLE) * skew * skew / 36))"


_METRICS = f""", m AS (SELECT ticker, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, stddev_pop(ret) AS sd0, var_samp(ret) AS v, kurtosis_pop(ret) AS kurt, quantile_cont(ret, 0.01) AS q1, quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.95) AS q95 FROM rets GROUP BY 1),
    k AS (SELECT r.ticker, avg((ret - mean) ^ 3) / pow(avg((ret - mean) ^ 2), 1.5) AS skew FROM rets r JOIN m USING (ticker) WHERE ret IS NOT NULL GROUP BY 1),
    b AS (SELECT *, -(mean + sd0 * {_Z95}::DOUBLE) AS var_95, -(mean + sd0 * {_Z99}::DOUBLE) AS var_99, {_cf(_Z95)} AS cornish_fisher_var_95, {_cf(_Z99)} AS cornish_fisher_var_99 FROM m JOIN k USING (ticker)),
    t AS (SELECT r.ticker, -avg(ret) FILTER (ret <= -var_95) AS t95, -avg(ret) FILTER (ret <= -var_99) AS t99, avg(ret * ret) FILTER (ret < 0) AS neg2, avg(ret) FILTER (ret > 0) AS up, sum(ret) FILTER (ret > 0) AS gains, -sum(ret) FILTER (ret < 0) AS losses,
      avg((ret - 0.03 / 252) ^ 2) FILTER (ret - 0.03 / 252 < 0) AS ex2, avg(CASE WHEN ret < -var_95 THEN 1.0 ELSE 0.0 END) AS breach FROM rets r JOIN b USING (ticker) WHERE ret IS NOT NULL GROUP BY 1),
    dd AS (SELECT ticker, -min(growth / peak - 1) AS max_drawdown FROM peaked WHERE ret IS NOT NULL GROUP BY 1)"""


@query(
    _RET
    + _GROWTH
    + _METRICS
    + f"""SELECT ticker, n, {", ".join(f"round({c}, 6) AS {c}" for c in ("var_95", "var_99", "cornish_fisher_var_95", "cornish_fisher_var_99", "max_drawdown"))}, round(-q5, 6) AS historical_var_95, round(-q1, 6) AS historical_var_99,
    round(coalesce(t95, var_95), 6) AS cvar_95, round(coalesce(t99, var_99), 6) AS cvar_99, round(sd * sqrt(252), 6) AS volatility, round(coalesce((mean - 0.03 / 252) / nullif(sd, 0) * sqrt(252), 0), 6) AS sharpe_ratio,
    round((mean - 0.03 / 252) / nullif(sqrt(ex2), 0) * sqrt(252), 6) AS sortino_ratio, round(mean * 252 / nullif(max_drawdown, 0), 6) AS calmar_ratio, round(coalesce(sqrt(neg2) * sqrt(252), 0), 6) AS downside_deviation, round(up / nullif(sqrt(neg2), 0), 6) AS upside_potential,
    round(gains / nullif(losses, 0), 6) AS omega_ratio, round(abs(q95 / nullif(q5, 0)), 6) AS tail_ratio, round(breach, 6) AS var_breach_probability, round(coalesce(mean / nullif(v, 0) * 0.25, 0), 6) AS kelly_fraction,
    round(sqrt(n * (n - 1)) / (n - 2) * skew, 5) AS skewness, round((n - 1) / ((n - 2.0) * (n - 3)) * ((n + 1) * kurt + 6), 5) AS excess_kurtosis FROM b JOIN t USING (ticker) JOIN dd USING (ticker)"""
)
def risk_metrics(spark, sf_dir):
    return rounded(risk.metrics(returns(spark, sf_dir)), skewness=5, excess_kurtosis=5)


@query(
    _RET
    + """, bench AS (SELECT date, avg(ret) AS bench FROM rets GROUP BY 1), j AS (SELECT ticker, ret, bench, ret - bench AS active FROM rets JOIN bench USING (date) WHERE ret IS NOT NULL AND bench IS NOT NULL),
    a AS (SELECT ticker, covar_samp(ret, bench) / nullif(var_samp(bench), 0) AS beta, avg(ret) AS r, avg(bench) AS b, avg(active) AS act, stddev_samp(active) AS te FROM j GROUP BY 1)
    SELECT ticker, round(coalesce(beta, 0), 6) AS beta, round((r - coalesce(beta, 0) * b) * 252, 6) AS alpha, round(te * sqrt(252), 6) AS tracking_error, round(act / nullif(te, 0) * sqrt(252), 6) AS information_ratio FROM a"""
)
def benchmark_risk(spark, sf_dir):
    r = returns(spark, sf_dir)
    return rounded(risk.against(r, r.groupBy("date").agg(F.avg("ret").alias("bench"))))


_CASES = ", ".join(f"('{n}', {sum(s.values()) / len(s)}::DOUBLE, {p}::DOUBLE)" for n, s, p in K.STRESS)


@query(
    _RET
    + f""", cases(scenario, shock, probability) AS (VALUES {_CASES}), m AS (SELECT ticker, avg(ret) AS mean, stddev_pop(ret) AS sd, count(ret) AS n FROM rets GROUP BY 1)
    SELECT ticker, scenario, round(probability, 6) AS probability, round(-(mean + shock + sd * {_Z99}::DOUBLE), 6) AS stressed_var_99, round(-(mean + shock) * n, 4) AS expected_loss FROM m, cases"""
)
def stress_tests(spark, sf_dir):
    return rounded(risk.stress(returns(spark, sf_dir), risk.scenarios(spark)), expected_loss=4)


@query(_RET + f" SELECT ticker, date, round({full('avg', 'ret', 252)} / nullif({full('stddev_samp', 'ret', 252)}, 0) * sqrt(252), 6) AS rolling_sharpe FROM rets")
def rolling_sharpe(spark, sf_dir):
    return rounded(risk.rolling_sharpe(returns(spark, sf_dir)).select("ticker", "date", "rolling_sharpe"))


@query(_RET + " SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS period, round(exp(sum(ln(1 + ret))) - 1, 6) AS period_return FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2")
def monthly_returns(spark, sf_dir):
    return rounded(backtest.calendar_returns(returns(spark, sf_dir)))


@query(
    _RET
    + " SELECT a.ticker AS a, b.ticker AS b, round(corr(a.ret, b.ret), 6) AS correlation, round(covar_samp(a.ret, b.ret), 6) AS covariance FROM rets a JOIN rets b ON a.date = b.date AND a.ticker <= b.ticker WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2"
)
def correlation_matrix(spark, sf_dir):
    return rounded(risk.correlations(returns(spark, sf_dir).withColumnRenamed("ticker", "asset")))


_REVERSION = (
    _CALM
    + f""", z AS (SELECT *, (close - {full("avg", "close", 20)}) / nullif({full("stddev_samp", "close", 20)}, 0) AS z FROM rets), placed AS (SELECT *, CASE WHEN z > 2 THEN -1 WHEN z < -2 THEN 1 ELSE 0 END AS signal, CASE WHEN z > 2 THEN -1 WHEN z < -2 THEN 1 ELSE 0 END AS position FROM z)"""
)
_MOMENTUM = (
    _CALM
    + f""", m AS (SELECT *, {full("avg", "ret", 20)} AS mom FROM rets), q AS (SELECT ticker, quantile_cont(mom, 0.3) AS lo, quantile_cont(mom, 0.7) AS hi FROM m GROUP BY 1),
    g AS (SELECT m.*, CASE WHEN mom > hi THEN 1 WHEN mom < lo THEN -1 ELSE 0 END AS signal FROM m JOIN q USING (ticker)), placed AS (SELECT *, coalesce(last_value(nullif(signal, 0) IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS position FROM g)"""
)
_RUN = f""", ran0 AS (SELECT *, coalesce(abs(position - {lag("position")}), 0) AS trade, coalesce({lag("position")}, 0) * ret AS gross FROM placed), ran1 AS (SELECT *, gross - trade * 0.002 AS net FROM ran0),
    ran2 AS (SELECT *, exp(sum(ln(1 + coalesce(net, 0))) OVER {W}) * 100000 AS equity FROM ran1), ran AS (SELECT *, equity / max(equity) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM ran2)"""


@query(_MOMENTUM + _RUN + " SELECT ticker, date, signal, position, CAST(trade AS INTEGER) AS trade, round(net, 6) AS net, round(equity, 3) AS equity, round(drawdown, 6) AS drawdown FROM ran")
def momentum_backtest(spark, sf_dir):
    r = backtest.run(backtest.momentum(calm_bars(spark, sf_dir)))
    return rounded(r.select("ticker", "date", "signal", "position", "trade", "net", "equity", "drawdown"), equity=3)


_SUMMARY = """, b AS (SELECT ticker, count(*) AS n, exp(sum(ln(1 + net))) AS growth, avg(net) AS mean, stddev_samp(net) AS sd, avg(net * net) FILTER (net < 0) AS neg2, -min(drawdown) AS dd, quantile_cont(net, 0.05) AS q05, CAST(count(*) FILTER (trade > 0) AS BIGINT) AS trades,
    count(*) FILTER (trade > 0 AND net > 0) AS wins, sum(net) FILTER (trade > 0 AND net > 0) AS won, -sum(net) FILTER (trade > 0 AND net < 0) AS lost, avg(CASE WHEN position <> 0 THEN 1.0 ELSE 0 END) AS time_in_market, sum(trade * 0.002::DOUBLE) AS total_cost FROM ran WHERE net IS NOT NULL GROUP BY 1),
    t AS (SELECT ticker, avg(net) AS tail FROM ran JOIN b USING (ticker) WHERE net <= q05 GROUP BY 1)"""


@query(
    _REVERSION
    + _RUN
    + _SUMMARY
    + """SELECT ticker, trades, round(growth - 1, 6) AS total_return, round(CASE WHEN growth > 0 THEN pow(growth, 252.0 / n) - 1 END, 6) AS annual_return, round(sd * sqrt(252), 6) AS volatility, round((mean - 0.02 / 252) / nullif(sd, 0) * sqrt(252), 6) AS sharpe_ratio,
    round((mean - 0.02 / 252) / nullif(sqrt(neg2), 0) * sqrt(252), 6) AS sortino_ratio, round(dd, 6) AS max_drawdown, round((pow(growth, 252.0 / n) - 1) / nullif(dd, 0), 6) AS calmar_ratio, round(-q05, 6) AS var_95, round(-tail, 6) AS cvar_95, round(wins / nullif(trades, 0), 6) AS win_rate,
    round(won / nullif(lost, 0), 6) AS profit_factor, round(time_in_market, 6) AS time_in_market, round(total_cost, 6) AS total_cost, round(growth * 100000, 3) AS final_equity FROM b JOIN t USING (ticker)"""
)
def mean_reversion_summary(spark, sf_dir):
    return rounded(backtest.summary(backtest.run(backtest.mean_reversion(calm_bars(spark, sf_dir)))), final_equity=3)


@query(
    _MOMENTUM
    + _RUN
    + f""", n AS (SELECT *, coalesce(CAST(position <> {lag("position")} AS INTEGER), 1) AS new FROM ran), r AS (SELECT *, sum(new) OVER {W} AS run FROM n),
    g2 AS (SELECT ticker, run, min(date) AS entry_date, arg_min(equity, date) AS entry_equity, first(position) AS position, count(*) AS bars FROM r GROUP BY 1, 2),
    t AS (SELECT *, lead(entry_date) OVER (PARTITION BY ticker ORDER BY run) AS exit_date, lead(entry_equity) OVER (PARTITION BY ticker ORDER BY run) AS exit_equity FROM g2)
    SELECT ticker, position, entry_date, exit_date, round(entry_equity, 3) AS entry_equity, round(exit_equity, 3) AS exit_equity, bars, round(exit_equity / nullif(entry_equity, 0) - 1, 6) AS trade_return, CAST(exit_date - entry_date AS INTEGER) AS days FROM t WHERE position <> 0 AND exit_date IS NOT NULL"""
)
def trade_log(spark, sf_dir):
    return rounded(backtest.trade_log(backtest.run(backtest.momentum(calm_bars(spark, sf_dir)))), entry_equity=3, exit_equity=3)


@query(
    _REVERSION
    + f""", i AS (SELECT *, CAST(position <> 0 AS INTEGER) AS inside FROM placed), n AS (SELECT *, coalesce(CAST(inside <> {lag("inside")} AS INTEGER), 1) AS new FROM i), r AS (SELECT *, sum(new) OVER {W} AS run FROM n),
    g AS (SELECT ticker, run, max(inside) AS inside, count(*) AS n FROM r GROUP BY 1, 2), l AS (SELECT *, max(run) OVER (PARTITION BY ticker) AS last FROM g) SELECT ticker, round(avg(n) FILTER (inside = 1 AND run < last), 6) AS avg_holding_period FROM l GROUP BY 1"""
)
def holding_period(spark, sf_dir):
    return rounded(backtest.holding_period(backtest.mean_reversion(calm_bars(spark, sf_dir))))


@query(
    _REVERSION
    + _RUN
    + f""", o AS (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM ran), s AS (SELECT ticker, max(n) AS n FROM o GROUP BY 1), w AS (SELECT ticker, unnest(range(0, CAST(floor((n - 315) / 21.0) AS BIGINT) + 1)) AS window FROM s WHERE n >= 315)
    SELECT w.ticker, CAST(w.window AS BIGINT) AS window, min(date) AS test_start, max(date) AS test_end, count(*) AS bars, round(exp(sum(ln(1 + coalesce(net, 0)))) - 1, 6) AS test_return, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 6) AS test_sharpe
    FROM w JOIN o ON w.ticker = o.ticker AND o.i >= w.window * 21 + 252 AND o.i < w.window * 21 + 315 GROUP BY 1, 2"""
)
def walk_forward(spark, sf_dir):
    return rounded(backtest.walk_forward(backtest.run(backtest.mean_reversion(calm_bars(spark, sf_dir)))))


@query(
    """WITH t AS (SELECT p_brand AS asset, sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part) AS target FROM part GROUP BY 1), c AS (SELECT p_brand AS asset, count(*) / (SELECT count(*)::DOUBLE FROM part) AS weight FROM part WHERE p_size > 10 GROUP BY 1),
    p AS (SELECT p_brand AS asset, round(avg(p_retailprice), 2) AS price FROM part GROUP BY 1), j AS (SELECT asset, target, coalesce(weight, 0) AS current, price, target - coalesce(weight, 0) AS d FROM t LEFT JOIN c USING (asset) LEFT JOIN p USING (asset))
    SELECT asset, round(target, 6) AS target, round(current, 6) AS current, price, round(d, 6) AS weight_change, CAST(trunc(d * 1e6 / price) AS BIGINT) AS shares FROM j WHERE abs(d) > 0.001 AND trunc(d * 1e6 / price) <> 0"""
)
def rebalancing(spark, sf_dir):
    from finweave.functions.num import near

    p = D.read(spark, sf_dir, "part")
    whole = p.agg(F.sum("p_retailprice").alias("v"), F.count(F.lit(1)).alias("n"))
    by = p.groupBy(F.col("p_brand").alias("asset"))
    target = by.agg(F.sum("p_retailprice").alias("s")).crossJoin(F.broadcast(whole)).select("asset", (F.col("s") / F.col("v")).alias("weight"))
    current = p.filter("p_size > 10").groupBy(F.col("p_brand").alias("asset")).agg(F.count(F.lit(1)).alias("s")).crossJoin(F.broadcast(whole)).select("asset", (F.col("s") / F.col("n")).alias("weight"))
    prices = by.agg(near(F.avg("p_retailprice"), 2).alias("price"))
    return rounded(backtest.rebalance(target, current, prices, 1e6, 0.001))


def _poly(cs, x: str) -> str:
    out = f"{cs[0]}::DOUBLE"
    for c in cs[1:]:
        out = f"({out} * {x} + {c}::DOUBLE)"
    return out


#: The normal quantile of u with the coefficients of the operator's approximation.
_PPF = f"""CASE WHEN least(u, 1 - u) < 0.02425 THEN sign(0.5 - u) * {_poly(num._C, "q")} / ({_poly(num._D, "q")} * q + 1)
      ELSE {_poly(num._A, "r")} * (u - 0.5) / ({_poly(num._B, "r")} * r + 1) END"""


@query(
    _CALM
    + f""", m AS (SELECT ticker, avg(ret) AS mean, stddev_samp(ret) AS sd FROM rets WHERE ret IS NOT NULL GROUP BY 1),
    us AS (SELECT m.*, path, (CAST('0x' || substr(md5('42:' || ticker || ':' || path || ':' || day), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS u FROM m, range(1, 201) paths(path), range(1, 61) days(day)),
    zs AS (SELECT *, sqrt(-2 * ln(least(u, 1 - u))) AS q, (u - 0.5) * (u - 0.5) AS r FROM us),
    ends AS (SELECT ticker, path, exp(sum(ln(1 + mean + sd * ({_PPF})))) - 1 AS total FROM zs GROUP BY 1, 2)
    SELECT ticker, count(*) AS paths, round(avg(total), 6) AS mean_return, round(quantile_cont(total, 0.5), 6) AS median_return, round(stddev_samp(total), 6) AS std_return, round(avg(CASE WHEN total < 0 THEN 1.0 ELSE 0.0 END), 6) AS loss_probability,
    round(-quantile_cont(total, 0.05), 6) AS var, round(min(total), 6) AS worst, round(max(total), 6) AS best FROM ends GROUP BY 1"""
)
def monte_carlo(spark, sf_dir):
    return rounded(risk.monte_carlo(calm_returns(spark, sf_dir), paths=200, days=60))


@query()
def bootstrap_intervals(spark, sf_dir):
    return risk.bootstrap(calm_returns(spark, sf_dir))


@query()
def model_vars(spark, sf_dir):
    return risk.model_vars(calm_returns(spark, sf_dir))
