"""Edge rows, worked values and properties of the operators."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from finweave.functions import num
from finweave.functions import text as X
from finweave.operators import anomaly, backtest, factors, facts, forecast, indicators, insights, macro, peers, ratios, reports, retrieval, risk, text, variance
from finweave.sources import readers, sinks
from finweave.streaming import windows

# Worked values -----------------------------------------------------------------


def test_ewm_matches_the_golden_series(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 4.0, 3.0, 8.0])], "ticker string, date int, close double")
    got = [r["ema_3"] for r in indicators.ewm(d, (3,)).orderBy("date").collect()]
    assert got == [1, 1.5, 2.75, 2.875, 5.4375]


def test_percent_rank_with_ties_and_nulls(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 2.0, 2.0, 7.0, 3.0])], "i int, v double")
    got = [r[0] for r in d.select("i", num.percent_rank_avg("v").alias("p")).orderBy("i").select("p").collect()]
    want = [14.2857, 42.8571, None, 85.7143, 42.8571, 42.8571, 100, 71.4286]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-3) for a, b in zip(got, want, strict=True))


def test_market_cap_peers(spark):
    d = spark.createDataFrame([("MSFT", "Technology", 2800e9), ("GOOGL", "Technology", 1700e9), ("XOM", "Energy", 2900e9), ("TINY", "Technology", 1e9)], "ticker string, sector string, market_cap double")
    got = [(r["ticker"], round(r["similarity_score"], 4)) for r in peers.by_market_cap(d, 3000e9, "Technology", 0.8, 5).collect()]
    assert got == [("MSFT", 0.9333), ("GOOGL", 0.5667)]


def test_chunk_id():
    import hashlib

    assert "chunk_" + hashlib.md5(b"doc_0_abc").hexdigest()[:12] == "chunk_baf10b3ea2e2"


def test_chunk_id_expression(spark):
    assert spark.range(1).select(X.chunk_id(F.lit("doc"), F.lit("0"), F.lit("abc"))).first()[0] == "chunk_baf10b3ea2e2"


@pytest.mark.parametrize("p", [0.001, 0.01, 0.05, 0.5, 0.9, 0.999])
def test_normal_law(spark, p):
    x = num.norm_ppf(p)
    assert abs(0.5 * math.erfc(-x / 2**0.5) - p) < 1e-8
    a, b = spark.range(1).select(num.norm_ppf_col(F.lit(p)), num.norm_cdf_col(F.lit(float(x)))).first()
    assert abs(a - x) < 1e-9 and abs(b - p) < 1e-6


# Edges -------------------------------------------------------------------------


def bars(spark, closes, ticker="a"):
    return spark.createDataFrame([(ticker, i, c, c, c, c, 10) for i, c in enumerate(closes)], "ticker string, date int, open double, high double, low double, close double, volume long")


def test_rsi_only_gains_losses_and_flat(spark):
    last = lambda xs: indicators.rsi(bars(spark, xs), 3).orderBy(F.desc("date")).first()["rsi_3"]
    assert last([1.0, 2.0, 3.0, 4.0]) == 100
    assert last([4.0, 3.0, 2.0, 1.0]) == 0
    assert last([5.0, 5.0, 5.0, 5.0]) is None
    assert last([5.0, 6.0]) is None


def test_series_do_not_mix(spark):
    both = bars(spark, [1.0, 2.0], "a").union(bars(spark, [50.0, 60.0], "b"))
    got = {(r["ticker"], r["date"]): r["daily_return"] for r in indicators.price_metrics(both).collect()}
    assert got["a", 0] is None and got["b", 0] is None and abs(got["b", 1] - 0.2) < 1e-12


def test_ratios_of_zero_negative_and_missing(spark):
    d = spark.createDataFrame([("a", 1, 10.0, 0.0, 5.0, None), ("b", 1, 10.0, -4.0, 5.0, 20.0)], "ticker string, fiscal_year int, CurrentAssets double, CurrentLiabilities double, Revenue double, Assets double")
    got = {(r["ticker"], r["ratio_name"]) for r in ratios.all_ratios(d).collect()}
    # working capital is positive in both, current liabilities are in neither
    assert got == {("b", "asset_turnover"), ("a", "working_capital_turnover"), ("b", "working_capital_turnover")}
    assert ratios.wide(d).columns[:3] == ["ticker", "fiscal_year", "current_ratio"]


def test_growth_needs_the_year_before(spark):
    d = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 15.0), ("a", 4, 30.0), ("b", 1, -1.0), ("b", 2, 5.0)], "ticker string, fiscal_year int, Revenue double").withColumns({c: F.lit(None).cast("double") for c in ("NetIncome", "Assets", "OperatingCashFlow")})
    got = {(r[0], r[1]): r["revenue_growth"] for r in ratios.growth(d).collect()}
    assert got == {("a", 1): None, ("a", 2): 0.5, ("a", 4): None, ("b", 1): None, ("b", 2): None}


def test_dupont_parts_add_up(spark):
    g = np.random.default_rng(0)
    d = spark.createDataFrame([("a", y, *map(float, g.uniform(1, 9, 4))) for y in range(8)], "ticker string, fiscal_year int, NetIncome double, Revenue double, Assets double, Equity double")
    for r in variance.dupont(d).collect():
        assert abs(r["npm_impact"] + r["turnover_impact"] + r["leverage_impact"] - r["roe_change"]) < 1e-9


def test_variance_sides_and_zero_prior(spark):
    cur = spark.createDataFrame([("a", "Revenue", 5.0), ("a", "Assets", -3.0)], "ticker string, metric_name string, value double")
    old = spark.createDataFrame([("a", "Revenue", 0.0), ("a", "Equity", 4.0)], "ticker string, metric_name string, value double")
    got = {r["metric_name"]: (r["percent_change"], r["is_favorable"]) for r in variance.period_variance(cur, old).collect()}
    assert got == {"Revenue": (100.0, True), "Assets": (-100.0, False), "Equity": (-100.0, False)}


def test_facts_skip_bad_json_and_keep_the_last_filed(spark):
    item = lambda v, filed: {"val": v, "fy": 2020, "fp": "FY", "form": "10-K", "filed": filed, "accn": "x", "end": "bad date"}
    good = {"cik": "1", "entityName": "A", "facts": {"us-gaap": {"Assets": {"units": {"USD": [item(1.0, "2021-01-01"), item(2.0, "2021-05-01"), {**item(9.0, "2022-01-01"), "form": "S-1"}]}}, "Other": {"units": {"USD": [item(5.0, "2021-01-01")]}}}}}
    d = spark.createDataFrame([(json.dumps(good),), ("{broken",), (None,)], "json string")
    rows = facts.flatten(d).collect()
    assert [(r["metric"], r["value"], r["end_date"]) for r in rows] == [("Assets", 2.0, None)]
    assert facts.flatten(d, years=[1999]).count() == 0


def test_filings_and_sections_are_read(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": "320193", "ticker": "aapl", "title": "A"}, "1": {"cik_str": "1", "ticker": "AAPL", "title": "B"}}))
    t = readers.tickers(spark, str(tmp_path / "t.json"))
    assert [tuple(r) for r in t.collect()] == [("AAPL", "0000000001", "B")]
    d = tmp_path / "s"
    d.mkdir()
    (d / "2023.json").write_text(json.dumps({"7": "text of seven", "1A": "risks"}))
    (d / "2024.json").write_text("no json")
    assert [(r["section"], r["text"]) for r in readers.sections(spark, str(d)).collect()] == [("1A", "risks"), ("7", "text of seven")]
    sub = spark.createDataFrame([(json.dumps({"cik": "1", "filings": {"recent": {"accessionNumber": ["0-1-2", "0-1-3"], "form": ["8-K", "10-K"], "filingDate": ["2021-02-01", "2021-03-01"]}}}),)], "json string")
    assert facts.yearly_filing(facts.submissions(sub), 2020).first()["accession"] == "013"


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(sinks.replace(old, new, ["k"], [F.col("v")])) == {(1, "a"), (2, "y"), (3, "z")}
    assert as_set(sinks.ignore(old, new, ["k"], [F.col("v")])) == {(1, "a"), (2, "b"), (3, "z")}
    assert as_set(sinks.update(old, new, ["k"], ["v"], [F.col("v")])) == {(1, "a"), (2, "y"), (3, "z")}
    assert as_set(sinks.delete(old, new.select("k").distinct())) == {(1, "a")}


def test_as_of_takes_the_latest_not_after(spark):
    left = spark.createDataFrame([("a", 5, "l5"), ("a", 1, "l1"), ("b", 9, "b9")], "k string, t int, x string")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("a", 6, 60.0)], "k string, t int, y double")
    assert {(r["x"], r["y"]) for r in macro.as_of(left, right, ["k"], "t", ["y"]).collect()} == {("l5", 50.0), ("l1", None), ("b9", None)}


def test_drawdown_of_a_rise_is_zero(spark):
    d = spark.createDataFrame([("a", i, 0.1 if i else None) for i in range(5)] + [("b", 0, -0.5), ("b", 1, 1.0)], "ticker string, date int, ret double")
    got = {r["ticker"]: r["max_drawdown"] for r in risk.max_drawdown(d).collect()}
    assert got["a"] == 0 and got["b"] == 0  # the peak starts at the first value


def test_evt_and_garch_are_sane():
    x = np.random.default_rng(3).normal(0, 0.01, 3000)
    assert 0.014 < risk.evt_var(x, 0.95) < 0.019 and 0.012 < risk.garch_var(x, 0.95) < 0.021
    assert math.isnan(risk.garch_var(np.zeros(50), 0.95)) and math.isnan(risk.evt_var(np.array([np.nan]), 0.95))
    m = np.random.default_rng(4).normal(0, 0.01, (800, 3))
    assert 0.005 < risk.copula_var(m) < 0.015


def test_trades_close_and_hold(spark):
    d = spark.createDataFrame([("a", i, p, 0.01) for i, p in enumerate([0, 1, 1, -1, 0, 1])], "ticker string, i int, position int, ret double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")))
    log = backtest.trade_log(backtest.run(d)).orderBy("entry_date").collect()
    assert [(r["position"], r["bars"]) for r in log] == [(1, 2), (-1, 1)]
    assert backtest.holding_period(d).first()["avg_holding_period"] == 3


# Text ----------------------------------------------------------------------------


def test_sentences_and_merging(spark):
    t = "One. Two is here! Is three? " + "x" * 60 + ". Last"
    s, m = spark.createDataFrame([(t,)], "text string").select(X.sentences(F.col("text")), X.merged(X.sentences(F.col("text")))).first()
    assert s == ["One.", "Two is here!", "Is three?", "x" * 60 + ".", "Last"] and m == ["One. Two is here! Is three?", "x" * 60 + ".", "Last"]


def test_packing_of_sentences():
    t = " ".join(f"Sentence number {i} is here." for i in range(60))
    parts = text.packed(t, 200, 60)
    assert all(len(p) <= 200 for p in parts) and all(a.split(". ")[-1].rstrip(".") in b for a, b in zip(parts, parts[1:], strict=False))
    assert text.packed("", 10) == [] and text.packed("y" * 50, 10) == ["y" * 50]


def test_windows_at_the_border(spark):
    d = spark.createDataFrame([("",), ("a" * 1000,), ("a" * 1001,), (None,)], "text string")
    assert [r[0] for r in d.select(F.size(X.windows(F.col("text")))).collect()] == [0, 1, 2, 0]


def test_sections_last_occurrence_counts():
    body = "w " * 80
    t = f"Item 1A. Risk Factors toc Item 2. Properties toc Item 1A. Risk Factors {body} Item 2. Properties {body}"
    assert [s[0] for s in text.find_sections(t)] == ["item_1a", "item_2"]


def test_entities_figures_tables(spark):
    d = spark.createDataFrame([("Revenue of $1,234.5 million in 2023, up 12.5%. Net income was 2 billion in 2022",)], "text string")
    e, r = d.select(X.entities(F.col("text")), X.amount(F.col("text"), X.FIGURES["revenue"])).first()
    assert e == ["$1,234.5 million", "12.5%", "2022", "2023"] and r == 1234.5e6
    assert text.text_tables("head\nA  1  2\nB\t3\t4\n\nend 5 6") == [[["A", "1", "2"], ["B", "3", "4"]], [["end 5 6"]]]
    assert spark.range(1).select(text.numeric(F.lit("($1,200.50)"))).first()[0] == -1200.5


def test_similarity_with_zero_and_self(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "id int, embedding array<double>")
    got = [(r["id"], r["similarity"]) for r in retrieval.similar_to(v, 1, 5).collect()]
    assert got == [(2, 1.0), (4, 0.0), (3, None)]


def test_answers_are_repaired(spark):
    d = spark.createDataFrame([('{"answer": "a", "citations": []}',), ('text {"answer": "b"} more',), ("plain",)], "raw string")
    assert [r[0]["answer"] for r in d.select(retrieval.parsed_answer(F.col("raw"))).collect()] == ["a", "b", "plain"]


def test_embeddings_have_length_one(spark):
    d = spark.createDataFrame([(1, "some text here"), (2, "some text here"), (3, "other")], "id int, text string")
    e = {r["id"]: r["embedding"] for r in retrieval.embed(d, 16).collect()}
    assert e[1] == e[2] != e[3] and abs(sum(x * x for x in e[1]) - 1) < 1e-9


# Models --------------------------------------------------------------------------


def spd(k=5, seed=1):
    a = np.random.default_rng(seed).normal(size=(k, 3 * k))
    return a @ a.T / (3 * k)


@pytest.mark.parametrize("name", list(factors.METHODS))
def test_portfolios_are_weights(name):
    s = spd()
    w = factors.METHODS[name](np.array([0.1, 0.2, 0.05, 0.15, 0.12]), s)
    assert abs(w.sum() - 1) < 1e-6 and (w >= -1e-9).all()
    marginal, part = factors.contributions(w, s)
    assert abs(part.sum() - math.sqrt(w @ s @ w)) < 1e-9


def test_risk_parity_is_equal_and_min_volatility_minimal():
    s = spd()
    part = factors.contributions(factors.risk_parity(s), s)[1]
    assert part.std() < 1e-6
    w = factors.min_volatility(s)
    g = np.random.default_rng(2)
    assert all(w @ s @ w <= v @ s @ v + 1e-9 for v in g.dirichlet(np.ones(5), 300))


def test_factor_statistics():
    c = np.eye(4)
    x, p = factors.bartlett(c, 100)
    assert abs(x) < 1e-9 and p == 1 and abs(factors.chi2_tail(3.841, 1) - 0.05) < 1e-3
    assert 0 <= factors.kmo(factors.correlation(spd())) <= 1
    load = np.linalg.eigh(spd())[1][:, :2]
    r = factors.varimax(load)
    assert np.allclose(r @ r.T, load @ load.T)


def test_common_factors_and_components():
    load = np.array([[0.9, 0], [0.8, 0], [0.7, 0], [0, 0.9], [0, 0.8], [0, 0.6]])
    corr = load @ load.T
    np.fill_diagonal(corr, 1)
    got, unique = factors.common_factors(corr, 2)
    assert np.allclose(got @ got.T + np.diag(unique), corr, atol=1e-3)
    g = np.random.default_rng(1)
    src = g.laplace(size=(5000, 2))
    x = src @ np.array([[1.0, 0.6], [-0.4, 1.0]]).T
    est, mix = factors.independent(x, 2)
    c = np.abs(np.corrcoef(np.column_stack([est, src]).T)[:2, 2:])
    assert (c.max(1) > 0.97).all() and np.allclose(est @ mix.T, x - x.mean(0), atol=1e-6)


def test_efficient_for_a_stated_return():
    mu, s = np.array([0.1, 0.2, 0.05]), spd(3)
    least = float(factors.min_volatility(s) @ mu)
    value = (least + 0.2) / 2  # the frontier goes from the least risk's return to the greatest
    w = factors.efficient_for(mu, s, value)
    assert abs(w @ mu - value) < 5e-3 and abs(w.sum() - 1) < 1e-6
    assert abs(factors.efficient_for(mu, s, least - 0.1) @ mu - least) < 5e-3


def test_page_tables(spark):
    html = "<p>x</p><table><tr><th>A</th><th> B&amp;C </th></tr><tr><td>1</td><td><b>2</b></td></tr></table><table></table>"
    assert text.html_tables(html) == [[["A", "B&C"], ["1", "2"]]]
    d = spark.createDataFrame([(1, html), (2, None)], "document_id int, text string")
    assert [tuple(r) for r in text.page_tables(d).orderBy("row").collect()] == [(1, 0, 0, ["A", "B&C"]), (1, 0, 1, ["1", "2"])]


def test_reports_format_nothing_as_a_dash(spark):
    d = spark.createDataFrame([(1234.5,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in d.select(reports.currency(F.col("v"))).collect()] == ["USD 1,234.50", "-", "-"]


def test_allocation_spends_what_it_can():
    n, cash = factors.allocation({"a": 0.6, "b": 0.4}, {"a": 30.0, "b": 7.0}, 1000)
    assert n["a"] == 20 and cash >= 0 and 30 * n["a"] + 7 * n["b"] + cash == 1000


def test_forecasts_of_a_line_and_of_short_series(spark):
    d = spark.createDataFrame([("a", i, 10.0 + 2 * i) for i in range(12)] + [("b", 0, 1.0)], "ticker string, fiscal_year int, value double")
    got = forecast.forecasts(d, 3).collect()
    line = [r["forecast"] for r in sorted((r for r in got if r["model"] == "trend"), key=lambda r: r["step"])]
    assert np.allclose(line, [34, 36, 38]) and {r["ticker"] for r in got} == {"a"}
    assert forecast.best_model(forecast.forecasts(d, 3)).first()["best_model"] == "trend"
    wave = spark.createDataFrame([("w", i, 10.0 + 3 * [1, 0, -1, 0][i % 4]) for i in range(16)], "ticker string, fiscal_year int, value double")
    assert forecast.best_model(forecast.forecasts(wave, 3)).first()["best_model"] in ("seasonal", "autoregression")


def test_gaps_are_filled(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, None, None, 4.0, None, None, None, None])], "ticker string, fiscal_year int, v double")
    got = [r["v"] for r in forecast.filled(d, ["v"]).orderBy("fiscal_year").collect()]
    assert got[:2] == [1.0, 1.0] and abs(got[2] - 3.0) < 1e-9 and got[4] == 4.0 and got[7] == 2.5


def test_multivariate_finds_the_odd_row(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(200, 1)) @ np.ones((1, 3)) + 0.1 * g.normal(size=(200, 3))
    x[7] = [3, -3, 3]
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    got = anomaly.multivariate(d, ("a", "b", "c"), components=1).filter("is_anomaly").collect()
    assert 7 in {r["i"] for r in got}


def test_insights_with_missing_parts(spark):
    d = spark.createDataFrame([("a", 2.0), ("b", None)], "ticker string, sharpe_ratio double")
    got = {r["ticker"]: r for r in insights.insights([d]).collect()}
    assert got["a"]["signal_score"] > got["b"]["signal_score"] and got["b"]["signal"] == "HOLD"
    assert got["a"]["key_drivers"] == ["Attractive risk-adjusted returns: Sharpe 2.00"] and got["b"]["risk_warnings"] == []


# Streaming -----------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = windows.tumbling(windows.timed(windows.stream(spark, str(tmp_path / "in"), 3), "40 days"))
    q = s.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["events"], round(r["total"], 4)) for r in df.collect())
    assert key(spark.table("tumbled")) == key(windows.tumbling(e.withColumn("ts", F.col("ts").cast("timestamp"))))


def test_reports_are_text(spark):
    d = pd.DataFrame({"ticker": ["a"], "metric_name": ["Revenue"], "value": [3.0]})
    v = variance.period_variance(spark.createDataFrame(d), spark.createDataFrame(d.assign(value=2.0)))
    r = variance.report(v).first()
    assert (r["current"], r["change"], r["mark"]) == ("3.00", "50.0%", "✓")


def test_paragraphs_fall_back_to_sentences(spark):
    from finweave.operators import text

    long_ = "One is here. Two is there. Three is far away."
    d = spark.createDataFrame([(1, f"aa\n\n bb \n\n\n\ncc\n\n{long_}\n\nlast"), (2, ""), (3, None), (4, "x" * 50), (5, " \n\n ")], "document_id long, text string")
    got = {}
    for r in text.paragraph_chunks(d, size=20, overlap=0).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r["document_id"], []).append(r["text"])
    assert got == {1: ["aa\n\nbb\n\ncc", "One is here.", "Two is there.", "Three is far away.", "last"], 4: ["x" * 50]}
    assert text.by_paragraph("aaaa\n\nbbbb\n\ncc", 6, 0) == ["aaaa", "bbbb\n\ncc"]


def test_ml_features_by_hand(spark):
    from datetime import date, timedelta

    from finweave.operators import indicators

    close = [100.0 + (i * 7 % 11) + i * 0.1 for i in range(230)]
    rows = [("A", date(2024, 1, 1) + timedelta(i), c, c + 1, c - 1, c, 1000.0 + i) for i, c in enumerate(close)]
    d = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    got = indicators.ml_features(d).orderBy("date").collect()
    ema = lambda xs, n: [y := xs[0]] + [y := y + 2 / (n + 1) * (x - y) for x in xs[1:]]  # noqa: E731, F841
    macd = [a - b for a, b in zip(ema(close, 12), ema(close, 26), strict=True)]
    signal = ema(macd, 9)
    for i, r in enumerate(got):
        for n in (20, 50, 200):
            want = close[i] / (sum(close[i - n + 1 : i + 1]) / n) - 1 if i >= n - 1 else None
            assert (r[f"price_to_sma_{n}"] is None) == (want is None) and (want is None or abs(r[f"price_to_sma_{n}"] - want) < 1e-9)
        crossed = i > 0 and macd[i] > signal[i] + 1e-12 and macd[i - 1] <= signal[i - 1] + 1e-12
        assert r["macd_cross_up"] == int(crossed)
    assert got[0]["rsi_oversold"] == 0


def test_simulated_paths_have_the_moments_asked_for(spark):
    """Draws are normal, and end values those of the closed form, in any partitioning."""
    d = spark.range(300).select(F.col("id").cast("string").alias("n"))
    z = np.array([r[0] for r in d.select(risk.normal_draws(F.col("n"), 60)).collect()])
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs((z < 1.6449).mean() - 0.95) < 0.01 and np.abs(np.corrcoef(z.T)[np.triu_indices(60, 1)]).max() < 0.25
    r = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.01, -0.008, 0.004] * 30)], "ticker string, date int, ret double")
    one, two = risk.monte_carlo(r.repartition(1), 2000, 40).first(), risk.monte_carlo(r.repartition(5), 2000, 40).first()
    assert all(np.isclose(a, b) for a, b in zip(one[1:], two[1:], strict=True))
    x = np.array([0.01, -0.008, 0.004] * 30)
    m, v = 1 + x.mean(), x.var(ddof=1)
    assert abs(one["mean_return"] - (m**40 - 1)) < 4 * one["std_return"] / 2000**0.5 and abs(one["std_return"] / ((m * m + v) ** 40 - m**80) ** 0.5 - 1) < 0.08
