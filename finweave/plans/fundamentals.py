"""Queries on statements, facts, peers and keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from finweave.functions import constants as K
from finweave.functions.num import near, rounded
from finweave.operators import facts, peers, ratios, variance
from finweave.plans.registry import query
from finweave.sources import domain as D
from finweave.sources import sinks

S = D.sql


@query(
    S("stmt", "long")
    + """ SELECT a.ticker, a.fiscal_year, a.metric_name, round(a.value, 6) AS current_value, round(p.value, 6) AS prior_value, round(a.value - p.value, 6) AS absolute_change,
    round((a.value - p.value) / nullif(p.value, 0) * 100, 6) AS percent_change
    FROM long a JOIN long p ON a.ticker = p.ticker AND a.metric_name = p.metric_name AND p.fiscal_year = a.fiscal_year - 1"""
)
def yoy_metrics(spark, sf_dir):
    return rounded(ratios.yoy(D.metric_rows(D.statements(spark, sf_dir))))


_RATIOS = """wide AS (SELECT ticker, fiscal_year,
 CASE WHEN CurrentLiabilities > 0 THEN CurrentAssets / CurrentLiabilities END AS current_ratio,
 CASE WHEN CurrentLiabilities > 0 THEN (CurrentAssets - Inventory) / CurrentLiabilities END AS quick_ratio,
 CASE WHEN CurrentLiabilities > 0 THEN Cash / CurrentLiabilities END AS cash_ratio,
 CASE WHEN CurrentLiabilities > 0 THEN OperatingCashFlow / CurrentLiabilities END AS operating_cash_ratio,
 CASE WHEN Equity > 0 THEN LongTermDebt / Equity END AS debt_to_equity,
 CASE WHEN Assets > 0 THEN Liabilities / Assets END AS debt_to_assets,
 CASE WHEN Assets > 0 THEN Equity / Assets END AS equity_ratio,
 CASE WHEN InterestExpense > 0 THEN OperatingIncome / InterestExpense END AS interest_coverage,
 CASE WHEN InterestExpense > 0 THEN OperatingCashFlow / InterestExpense END AS debt_service_coverage,
 CASE WHEN Revenue > 0 THEN GrossProfit / Revenue END AS gross_margin,
 CASE WHEN Revenue > 0 THEN OperatingIncome / Revenue END AS operating_margin,
 CASE WHEN Revenue > 0 THEN NetIncome / Revenue END AS net_margin,
 CASE WHEN Assets > 0 THEN NetIncome / Assets END AS roa,
 CASE WHEN Equity > 0 THEN NetIncome / Equity END AS roe,
 CASE WHEN Equity + LongTermDebt > 0 THEN OperatingIncome * (1 - 0.21::DOUBLE) / (Equity + LongTermDebt) END AS roic,
 CASE WHEN Assets > 0 THEN Revenue / Assets END AS asset_turnover,
 CASE WHEN PPE > 0 THEN Revenue / PPE END AS fixed_asset_turnover,
 CASE WHEN CurrentAssets - CurrentLiabilities > 0 THEN Revenue / (CurrentAssets - CurrentLiabilities) END AS working_capital_turnover,
 CASE WHEN Inventory > 0 THEN CostOfRevenue / Inventory END AS inventory_turnover,
 CASE WHEN AccountsReceivable > 0 THEN Revenue / AccountsReceivable END AS receivables_turnover,
 CASE WHEN Inventory > 0 THEN 365 / nullif(CostOfRevenue / Inventory, 0) END AS days_inventory,
 CASE WHEN AccountsReceivable > 0 THEN 365 / nullif(Revenue / AccountsReceivable, 0) END AS days_receivables FROM stmt)"""
_CATEGORY = "CASE " + " ".join(f"WHEN ratio_name IN ({', '.join(repr(x) for x in names)}) THEN '{c}'" for c, names in K.RATIO_CATEGORIES.items()) + " END"


def _bands_sql() -> str:
    out = []
    for ratio, bands in K.INTERPRETATIONS.items():
        for lo, hi, text in bands:
            cond = " AND ".join([f"ratio_name = '{ratio}'", *([f"value >= {lo}"] if lo is not None else []), *([f"value < {hi}"] if hi is not None else [])])
            out.append(f"WHEN {cond} THEN '{text}'")
    return "CASE " + " ".join(out) + f" ELSE '{K.NORMAL_RANGE}' END"


_HEALTH = (
    "CASE "
    + " ".join(
        f"WHEN ratio_name = '{r}' THEN "
        + (f"CASE WHEN value <= {i} THEN 100 ELSE greatest(0, 100 - 50 * (value - {i}) / {i}) END" if r == "debt_to_equity" else f"CASE WHEN value >= {i} THEN least(100, 50 + 50 * value / {i}) ELSE greatest(0, 50 * value / {i}) END")
        for r, i in K.IDEALS.items()
    )
    + " ELSE 50 END"
)
_MARK = "CASE " + " ".join(f"WHEN ratio_name = '{r}' THEN {v}" for r, v in K.INDUSTRY_BENCHMARKS["Technology"].items()) + " END"
_ALL_RATIOS = (
    S("stmt")
    + ", "
    + _RATIOS
    + ", rows AS (UNPIVOT wide ON COLUMNS(* EXCLUDE (ticker, fiscal_year)) INTO NAME ratio_name VALUE value)"
    + f", rated AS (SELECT ticker, fiscal_year, 'FY' AS fiscal_period, {_CATEGORY} AS category, ratio_name, value, {_bands_sql()} AS interpretation, round(CAST({_HEALTH} AS DOUBLE), 1) AS health_score, CAST({_MARK} AS DOUBLE) AS benchmark FROM rows WHERE value IS NOT NULL)"
)


@query(_ALL_RATIOS + " SELECT ticker, fiscal_year, fiscal_period, category, ratio_name, round(value, 6) AS value, interpretation, health_score, benchmark FROM rated")
def financial_ratios(spark, sf_dir):
    return rounded(ratios.all_ratios(D.statements(spark, sf_dir)), health_score=1)


@query(
    _ALL_RATIOS
    + """ SELECT ticker, fiscal_year, category, array_to_string(list_transform(string_split(ratio_name, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS ratio,
    round(value, 3) AS value, interpretation, health_score FROM rated"""
)
def ratio_report(spark, sf_dir):
    return ratios.report(ratios.all_ratios(D.statements(spark, sf_dir)))


@query(
    S("stmt")
    + """, lagged AS (SELECT *, lag(fiscal_year) OVER w = fiscal_year - 1 AS ok, lag(Revenue) OVER w AS r, lag(NetIncome) OVER w AS n, lag(Assets) OVER w AS a,
    lag(OperatingCashFlow) OVER w AS o FROM stmt WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year))
    SELECT ticker, fiscal_year, round(CASE WHEN ok AND r > 0 THEN (Revenue - r) / r END, 6) AS revenue_growth, round(CASE WHEN ok AND n > 0 THEN (NetIncome - n) / n END, 6) AS earnings_growth,
    round(CASE WHEN ok AND a > 0 THEN (Assets - a) / a END, 6) AS asset_growth, round(CASE WHEN ok AND o > 0 THEN (OperatingCashFlow - o) / o END, 6) AS operating_cash_flow_growth FROM lagged"""
)
def growth_ratios(spark, sf_dir):
    return rounded(ratios.growth(D.statements(spark, sf_dir)))


_STORED = """stored AS (SELECT ticker, fiscal_year, CurrentAssets / nullif(CurrentLiabilities, 0) AS current_ratio, (CurrentAssets - Inventory) / nullif(CurrentLiabilities, 0) AS quick_ratio,
 Cash / nullif(CurrentLiabilities, 0) AS cash_ratio, LongTermDebt / nullif(Equity, 0) AS debt_to_equity, Liabilities / nullif(Assets, 0) AS debt_to_assets, GrossProfit / nullif(Revenue, 0) AS gross_margin,
 OperatingIncome / nullif(Revenue, 0) AS operating_margin, NetIncome / nullif(Revenue, 0) AS net_margin, NetIncome / nullif(Assets, 0) AS roa, NetIncome / nullif(Equity, 0) AS roe,
 Revenue / nullif(Assets, 0) AS asset_turnover, CASE WHEN Inventory > 0 THEN CostOfRevenue / Inventory END AS inventory_turnover,
 CASE WHEN CostOfRevenue > 0 THEN Inventory * 365 / CostOfRevenue END AS days_inventory, CASE WHEN Revenue > 0 THEN AccountsReceivable * 365 / Revenue END AS days_receivables FROM stmt)"""


@query(S("stmt") + ", " + _STORED + " SELECT ticker, fiscal_year, round(COLUMNS(* EXCLUDE (ticker, fiscal_year)), 6), round(days_inventory + days_receivables, 6) AS cash_conversion_cycle FROM stored")
def stored_ratios(spark, sf_dir):
    return rounded(ratios.stored(D.statements(spark, sf_dir)))


@query(
    S("stmt")
    + ", "
    + _STORED
    + """ SELECT ticker, fiscal_year, round(current_ratio, 6) AS current_ratio, round(lag(current_ratio) OVER w, 6) AS prior_current_ratio, round(gross_margin, 6) AS gross_margin,
    round(lag(gross_margin) OVER w, 6) AS prior_gross_margin, round(roe, 6) AS roe, round(lag(roe) OVER w, 6) AS prior_roe FROM stored WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)"""
)
def ratio_trends(spark, sf_dir):
    return rounded(ratios.trends(ratios.stored(D.statements(spark, sf_dir))))


_DIRECTION = "CASE " + " ".join(f"WHEN metric_name = '{m}' THEN '{d}'" for m, d in K.FAVOURABLE.items() if d != "context") + " END"
_VARIANCE = (
    S("stmt", "long")
    + f""", a AS (SELECT ticker, metric_name, value FROM long WHERE fiscal_year = 1997 AND metric_name <> 'CapEx'), b AS (SELECT ticker, metric_name, value FROM long WHERE fiscal_year = 1996 AND metric_name <> 'PPE'),
    j AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.metric_name, b.metric_name) AS metric_name, coalesce(a.value, 0) AS current_value, coalesce(b.value, 0) AS prior_value
      FROM a FULL JOIN b ON a.ticker = b.ticker AND a.metric_name = b.metric_name),
    v AS (SELECT *, current_value - prior_value AS absolute_change, CASE WHEN prior_value <> 0 THEN (current_value - prior_value) / abs(prior_value) * 100 ELSE sign(current_value) * 100.0 END AS percent_change FROM j),
    variances AS (SELECT *, CASE {_DIRECTION} WHEN 'increase' THEN absolute_change > 0 WHEN 'decrease' THEN absolute_change < 0 END AS is_favorable,
      metric_name || ' shows a ' || CASE WHEN abs(percent_change) < 1 THEN 'minimal' WHEN abs(percent_change) < 5 THEN 'slight' WHEN abs(percent_change) < 10 THEN 'moderate' WHEN abs(percent_change) < 20 THEN 'significant' ELSE 'substantial' END
      || CASE WHEN percent_change > 0 THEN ' increase' ELSE ' decrease' END || ' of ' || printf('%.1f', abs(percent_change)) || '%' AS explanation FROM v)"""
)


def _variances(spark, sf_dir):
    rows = D.metric_rows(D.statements(spark, sf_dir))
    return variance.period_variance(rows.filter("fiscal_year = 1997 and metric_name <> 'CapEx'"), rows.filter("fiscal_year = 1996 and metric_name <> 'PPE'"))


@query(_VARIANCE + " SELECT ticker, metric_name, round(current_value, 6) AS current_value, round(prior_value, 6) AS prior_value, round(absolute_change, 6) AS absolute_change, round(percent_change, 6) AS percent_change, is_favorable, explanation FROM variances")
def period_variance(spark, sf_dir):
    return rounded(_variances(spark, sf_dir))


@query(
    _VARIANCE
    + """ SELECT ticker, metric_name, round(absolute_change, 2) AS absolute_change, round(percent_change, 6) AS percent_change,
    row_number() OVER (PARTITION BY ticker ORDER BY abs(absolute_change) DESC, metric_name) AS driver_rank FROM variances WHERE abs(percent_change) >= 10"""
)
def key_drivers(spark, sf_dir):
    d = variance.key_drivers(_variances(spark, sf_dir)).select("ticker", "metric_name", "absolute_change", "percent_change", F.col("driver_rank").cast("long").alias("driver_rank"))
    return rounded(d, absolute_change=2)


@query(
    _VARIANCE
    + """, ends AS (SELECT ticker, max(CASE WHEN metric_name = 'Revenue' THEN prior_value END) AS f, max(CASE WHEN metric_name = 'NetIncome' THEN current_value END) AS t FROM variances GROUP BY 1),
    moves AS (SELECT v.ticker, row_number() OVER w AS step, metric_name AS label, absolute_change AS amount, f + sum(absolute_change) OVER (PARTITION BY v.ticker ORDER BY abs(absolute_change) DESC, metric_name ROWS UNBOUNDED PRECEDING) AS cumulative
      FROM variances v JOIN ends USING (ticker) WHERE metric_name NOT IN ('Revenue', 'NetIncome') AND abs(absolute_change) > 0.01 AND f IS NOT NULL AND t IS NOT NULL WINDOW w AS (PARTITION BY v.ticker ORDER BY abs(absolute_change) DESC, metric_name))
    SELECT ticker, CAST(step AS INTEGER) AS step, label, round(amount, 2) AS amount, round(cumulative, 2) AS cumulative FROM (SELECT * FROM moves UNION ALL SELECT ticker, 0, 'Revenue (prior)', f, f FROM ends WHERE f IS NOT NULL AND t IS NOT NULL
    UNION ALL SELECT ticker, 10000, 'NetIncome (current)', t, t FROM ends WHERE f IS NOT NULL AND t IS NOT NULL)"""
)
def variance_waterfall(spark, sf_dir):
    return rounded(variance.waterfall(_variances(spark, sf_dir)), 2)


@query(
    S("stmt")
    + """, m AS (SELECT ticker, fiscal_year, GrossProfit / nullif(Revenue, 0) * 100 AS gross_margin, OperatingIncome / nullif(Revenue, 0) * 100 AS operating_margin, NetIncome / nullif(Revenue, 0) * 100 AS net_margin FROM stmt),
    r AS (UNPIVOT m ON gross_margin, operating_margin, net_margin INTO NAME margin VALUE current_value), l AS (SELECT a.*, b.current_value AS prior_value FROM r a JOIN r b ON a.ticker = b.ticker AND a.margin = b.margin AND b.fiscal_year = a.fiscal_year - 1)
    SELECT ticker, fiscal_year, margin, round(current_value, 6) AS current_value, round(prior_value, 6) AS prior_value, round(current_value - prior_value, 6) AS point_change,
    round(coalesce((current_value - prior_value) / nullif(abs(prior_value), 0) * 100, 0), 6) AS percent_change, current_value - prior_value > 0 AS is_favorable FROM l"""
)
def margin_changes(spark, sf_dir):
    return rounded(variance.margins(D.statements(spark, sf_dir)))


@query(
    S("stmt")
    + """, d AS (SELECT ticker, fiscal_year, NetIncome / nullif(Revenue, 0) AS n, Revenue / nullif(Assets, 0) AS t, Assets / nullif(Equity, 0) AS m FROM stmt)
    SELECT a.ticker, a.fiscal_year, round(a.n * a.t * a.m, 6) AS current_roe, round(b.n * b.t * b.m, 6) AS prior_roe, round(a.n * a.t * a.m - b.n * b.t * b.m, 6) AS roe_change, round((a.n - b.n) * b.t * b.m, 6) AS npm_impact,
    round(a.n * (a.t - b.t) * b.m, 6) AS turnover_impact, round(a.n * a.t * (a.m - b.m), 6) AS leverage_impact FROM d a JOIN d b ON a.ticker = b.ticker AND b.fiscal_year = a.fiscal_year - 1"""
)
def dupont(spark, sf_dir):
    return rounded(variance.dupont(D.statements(spark, sf_dir)))


@query(
    S("stmt")
    + """, w AS (SELECT ticker, fiscal_year, CurrentAssets - CurrentLiabilities AS WorkingCapital, Cash, AccountsReceivable, Inventory, CurrentLiabilities FROM stmt),
    r AS (UNPIVOT w ON WorkingCapital, Cash, AccountsReceivable, Inventory, CurrentLiabilities INTO NAME item VALUE current_value)
    SELECT a.ticker, a.fiscal_year, a.item, round(a.current_value, 2) AS current_value, round(b.current_value, 2) AS prior_value, round(a.current_value - b.current_value, 2) AS absolute_change,
    round(coalesce((a.current_value - b.current_value) / nullif(abs(b.current_value), 0) * 100, 0), 4) AS percent_change FROM r a JOIN r b ON a.ticker = b.ticker AND a.item = b.item AND b.fiscal_year = a.fiscal_year - 1"""
)
def working_capital_changes(spark, sf_dir):
    return rounded(variance.working_capital(D.statements(spark, sf_dir)), 2, percent_change=4)


# Peers -------------------------------------------------------------------


@query(
    S("companies")
    + """, n AS (SELECT count(*) FILTER (sic_code LIKE '7305%') AS n4, count(*) FILTER (sic_code LIKE '730%') AS n3 FROM companies)
    SELECT ticker, name, sector, industry, market_cap, sic_code FROM companies, n WHERE starts_with(sic_code, CASE WHEN n4 >= 5 THEN '7305' WHEN n3 >= 5 THEN '730' ELSE '73' END) ORDER BY ticker LIMIT 20"""
)
def peers_by_sic(spark, sf_dir):
    return peers.by_sic(D.companies(spark, sf_dir), "7305")


@query(S("companies") + " SELECT *, round(1 - abs(market_cap - 5000.0) / 5000.0, 9) AS similarity_score FROM companies WHERE market_cap BETWEEN 2500 AND 7500 AND sector = 'ASIA' ORDER BY similarity_score DESC, ticker LIMIT 15")
def peers_by_market_cap(spark, sf_dir):
    return peers.by_market_cap(D.companies(spark, sf_dir), 5000.0, "ASIA", 0.5, 15).withColumn("similarity_score", near("similarity_score", 9))


_TARGET = {"revenue": 5e6, "gross_margin": 0.4, "roe": 0.2, "debt_to_equity": 0.5, "asset_turnover": 0.6}


@query(
    S("stmt")
    + ", "
    + _STORED
    + """, f AS (SELECT s.ticker, Revenue AS revenue, gross_margin, roe, debt_to_equity, asset_turnover FROM stmt s JOIN stored t USING (ticker, fiscal_year) WHERE fiscal_year = 1997),
    z AS (SELECT """
    + ", ".join(f"stddev_samp({m}) AS s_{m}" for m in _TARGET)
    + " FROM f) SELECT ticker, round(revenue, 6) AS revenue, round(gross_margin, 6) AS gross_margin, round(roe, 6) AS roe, round(debt_to_equity, 6) AS debt_to_equity, round(asset_turnover, 6) AS asset_turnover, round("
    + " + ".join(f"CASE WHEN {m} IS NOT NULL THEN {K.SIMILARITY_WEIGHTS[m]} / (1 + coalesce(abs({m} - {v}) / nullif(s_{m}, 0), 0)) ELSE 0 END" for m, v in _TARGET.items())
    + ", 6) AS similarity_score FROM f, z ORDER BY similarity_score DESC, ticker LIMIT 20"
)
def peers_by_fundamentals(spark, sf_dir):
    stmt = D.statements(spark, sf_dir).filter("fiscal_year = 1997")
    m = ratios.stored(stmt).join(stmt.select("ticker", F.col("Revenue").alias("revenue")), "ticker").select("ticker", *_TARGET)
    return rounded(peers.by_fundamentals(_TARGET, m))


_NAMES = ["current_ratio", "gross_margin", "roe", "asset_turnover"]


@query(
    S("stmt")
    + ", "
    + _STORED
    + """, who AS (SELECT n_name AS ticker, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey), g AS ((SELECT DISTINCT ticker FROM who WHERE sector = (SELECT sector FROM who WHERE ticker = 'NATION_6') AND ticker <> 'NATION_6' ORDER BY ticker LIMIT 10) UNION ALL SELECT 'NATION_6'),
    x AS (SELECT * FROM stored WHERE fiscal_year = 1997 AND ticker IN (SELECT ticker FROM g)) SELECT ticker, fiscal_year, """
    + ", ".join(f"round({n}, 6) AS {n}, round((rank() OVER (ORDER BY {n}) + (count({n}) OVER (PARTITION BY {n}) - 1) / 2.0) / count({n}) OVER () * 100, 6) AS {n}_percentile" for n in _NAMES)
    + " FROM x"
)
def peer_comparison(spark, sf_dir):
    n, r = D.read(spark, sf_dir, "nation"), D.read(spark, sf_dir, "region")
    who = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"))
    return rounded(peers.comparison(ratios.stored(D.statements(spark, sf_dir)), who, "NATION_6", 1997, _NAMES))


_BENCH = (
    S("stmt")
    + ", "
    + _STORED
    + f""", r AS (UNPIVOT (SELECT ticker, {", ".join(_NAMES)} FROM stored WHERE fiscal_year = 1997) ON {", ".join(_NAMES)} INTO NAME metric_name VALUE value),
    b AS (SELECT c.ticker, c.metric_name, c.value AS company_value, quantile_cont(p.value, 0.5) AS peer_median, avg(p.value) AS peer_mean, stddev_samp(p.value) AS sd, min(p.value) AS peer_min, max(p.value) AS peer_max,
      quantile_cont(p.value, 0.25) AS peer_q1, quantile_cont(p.value, 0.75) AS peer_q3, avg(CASE WHEN p.value < c.value THEN 1.0 ELSE 0.0 END) * 100 AS percentile_rank, count(*) AS peer_count
      FROM r c JOIN r p ON c.metric_name = p.metric_name AND c.ticker <> p.ticker GROUP BY ALL),
    bench AS (SELECT * EXCLUDE (sd), coalesce((company_value - peer_mean) / nullif(sd, 0), 0) AS z_score,
      CASE WHEN percentile_rank >= 75 THEN 'Top Quartile' WHEN percentile_rank >= 50 THEN 'Above Median' WHEN percentile_rank >= 25 THEN 'Below Median' ELSE 'Bottom Quartile' END AS relative_performance FROM b)"""
)


def _bench(spark, sf_dir):
    rows = ratios.stored(D.statements(spark, sf_dir).filter("fiscal_year = 1997")).unpivot("ticker", _NAMES, "metric_name", "value")
    return peers.benchmark(rows, rows)


@query(
    _BENCH
    + " SELECT ticker, metric_name, relative_performance, peer_count, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("company_value", "peer_median", "peer_mean", "peer_min", "peer_max", "peer_q1", "peer_q3", "percentile_rank", "z_score"))
    + " FROM bench"
)
def peer_benchmark(spark, sf_dir):
    return rounded(_bench(spark, sf_dir))


_WEIGHTS = {"gross_margin": 0.5, "roe": 0.3, "pe_ratio": 0.2}


@query(_BENCH + " SELECT ticker, round(coalesce(sum(percentile_rank * CASE metric_name WHEN 'gross_margin' THEN 0.5 WHEN 'roe' THEN 0.3 END), 0) / 1.0, 6) AS composite_score FROM bench GROUP BY 1")
def composite_score(spark, sf_dir):
    return rounded(peers.composite(_bench(spark, sf_dir), _WEIGHTS))


@query(
    _BENCH
    + """, k AS (SELECT *, CASE WHEN percentile_rank >= 75 THEN 'strength' WHEN percentile_rank <= 25 THEN 'weakness' END AS kind FROM bench)
    SELECT ticker, kind, row_number() OVER (PARTITION BY ticker, kind ORDER BY CASE WHEN kind = 'strength' THEN -percentile_rank ELSE percentile_rank END, metric_name) AS place, metric_name,
    round(percentile_rank, 6) AS percentile_rank, round((company_value - peer_median) / nullif(abs(peer_median), 0) * 100, 6) AS vs_median FROM k WHERE kind IS NOT NULL"""
)
def strengths_weaknesses(spark, sf_dir):
    return rounded(peers.strengths(_bench(spark, sf_dir)).withColumn("place", F.col("place").cast("long")))


@query(_BENCH + " SELECT ticker, metric_name, round(coalesce(least(100, company_value / nullif(peer_median, 0) * 50), 50), 6) AS radius FROM bench")
def spider_values(spark, sf_dir):
    return rounded(peers.spider(_bench(spark, sf_dir)))


@query(
    S("companies")
    + " SELECT ticker, CASE "
    + " ".join(f"WHEN CAST(sic_code AS INTEGER) BETWEEN {lo} AND {hi} THEN '{i}'" for i, rs in K.SIC_RANGES.items() for lo, hi in rs)
    + " END AS sic_industry FROM companies"
)
def sic_industries(spark, sf_dir):
    return D.companies(spark, sf_dir).select("ticker", peers.sic_industry(F.col("sic_code")).alias("sic_industry"))


# Facts -------------------------------------------------------------------

_TAGGED = {m: t for m, t in K.FACT_TAGS.items() if m in D.METRICS}


def _facts_json(spark, sf_dir):
    """Company facts as their service sends them, with each value filed twice."""
    rows = D.metric_rows(D.statements(spark, sf_dir)).filter(F.col("metric_name").isin(*_TAGGED))
    tag = F.create_map(*[x for m, t in _TAGGED.items() for x in (F.lit(m), F.lit(t))])[F.col("metric_name")]

    def item(value, filed):
        return F.struct(value.alias("val"), F.col("fiscal_year").alias("fy"), F.lit("FY").alias("fp"), F.lit("10-K").alias("form"), F.concat(F.col("fiscal_year") + 1, F.lit(filed)).alias("filed"), F.lit("a-1").alias("accn"), F.concat("fiscal_year", F.lit("-12-31")).alias("end"))

    items = rows.withColumn("tag", tag).groupBy("ticker", "tag").agg(F.flatten(F.collect_list(F.array(item(F.col("value") + 1, "-02-01"), item(F.col("value"), "-03-01")))).alias("items"))
    tags = items.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct(F.create_map(F.lit("USD"), F.col("items")).alias("units"))))).alias("m"))
    return tags.select(F.to_json(F.struct(F.col("ticker").alias("cik"), F.col("ticker").alias("entityName"), F.create_map(F.lit("us-gaap"), F.col("m")).alias("facts"))).alias("json"))


@query(
    S("stmt", "long")
    + f""" SELECT ticker AS cik, metric_name AS metric, fiscal_year, 'FY' AS fiscal_period, 'USD' AS unit, round(value, 2) AS value, CAST((fiscal_year + 1) || '-03-01' AS DATE) AS filed, CAST(fiscal_year || '-12-31' AS DATE) AS end_date
    FROM long WHERE metric_name IN ({", ".join(repr(m) for m in _TAGGED)})"""
)
def facts_flattened(spark, sf_dir):
    f = facts.flatten(_facts_json(spark, sf_dir))
    return f.select("cik", "metric", "fiscal_year", "fiscal_period", "unit", near("value", 2).alias("value"), "filed", "end_date")


_DERIVED = """derived AS (UNPIVOT (SELECT ticker, fiscal_year, Revenue - CostOfRevenue AS GrossProfitCalc, (Revenue - CostOfRevenue) / nullif(Revenue, 0) AS GrossMargin, OperatingIncome / nullif(Revenue, 0) AS OperatingMargin,
 NetIncome / nullif(Revenue, 0) AS NetMargin, CurrentAssets - CurrentLiabilities AS WorkingCapitalCalc, CurrentAssets / nullif(CurrentLiabilities, 0) AS CurrentRatio, NetIncome / nullif(Assets, 0) AS ROA, NetIncome / nullif(Equity, 0) AS ROE,
 LongTermDebt / nullif(Equity, 0) AS DebtToEquity FROM stmt) ON COLUMNS(* EXCLUDE (ticker, fiscal_year)) INTO NAME metric_name VALUE value)"""


@query(S("stmt") + ", " + _DERIVED + " SELECT ticker, fiscal_year, metric_name, round(value, 6) AS value, 'calculated' AS source FROM derived WHERE value IS NOT NULL")
def derived_metrics(spark, sf_dir):
    return rounded(facts.derived(D.metric_rows(D.statements(spark, sf_dir))))


@query(
    S("stmt", "long")
    + ", "
    + _DERIVED
    + f""", u AS (SELECT ticker, fiscal_year, metric_name, value FROM long UNION ALL SELECT ticker, fiscal_year, metric_name, value FROM derived)
    SELECT ticker, metric_name, {", ".join(f"round(min(value) FILTER (fiscal_year = {y}), 6) AS fy{y}" for y in (1995, 1996, 1997))} FROM u WHERE metric_name IN ({", ".join(repr(m) for m in K.STATEMENTS["IS"])}) GROUP BY 1, 2"""
)
def income_statements(spark, sf_dir):
    return rounded(facts.statement(D.metric_rows(D.statements(spark, sf_dir)), "IS", (1995, 1996, 1997)))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'USD Millions' WHEN p_size % 4 = 1 THEN 'USD Thousands' WHEN p_size % 4 = 2 THEN 'Hundreds' ELSE 'USD' END AS unit,
    round(p_retailprice * CASE p_size % 4 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 WHEN 2 THEN 100 ELSE 1 END, 2) AS standard_value FROM part"""
)
def standardised_units(spark, sf_dir):
    unit = F.expr("case when p_size % 4 = 0 then 'USD Millions' when p_size % 4 = 1 then 'USD Thousands' when p_size % 4 = 2 then 'Hundreds' else 'USD' end")
    rows = D.read(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), F.col("p_retailprice").alias("value"))
    return facts.standardise(rows).select("p_partkey", "unit", near("standard_value", 2).alias("standard_value"))


@query(
    S("stmt", "long")
    + """, q AS (SELECT metric_name, count(value) AS n, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM long GROUP BY 1)
    SELECT 'outliers' AS check, metric_name AS item, CAST(count(*) AS BIGINT) AS found FROM long JOIN q USING (metric_name) WHERE n > 3 AND (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) GROUP BY 2
    UNION ALL SELECT 'metrics', ticker || ' ' || fiscal_year, count(DISTINCT metric_name) FROM long GROUP BY ticker, fiscal_year
    UNION ALL SELECT 'identity', ticker || ' ' || fiscal_year, 1 FROM stmt WHERE abs(Assets - Liabilities - Equity) > 0.01 * abs(Assets)
    UNION ALL SELECT 'missing', metric_name, CAST(round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) * 100) AS BIGINT) FROM long GROUP BY metric_name"""
)
def data_quality(spark, sf_dir):
    rows = D.metric_rows(D.statements(spark, sf_dir))
    year = F.concat_ws(" ", "ticker", "fiscal_year")
    parts = (
        facts.outliers(rows).select(F.lit("outliers").alias("check"), F.col("metric_name").alias("item"), F.col("outliers").alias("found")),
        facts.metrics_per_year(rows).select(F.lit("metrics"), year, "metrics"),
        facts.identity_breaks(rows).select(F.lit("identity"), year, F.lit(1).cast("long")),
        facts.missing(rows).select(F.lit("missing"), "metric_name", near("missing_percent", 0).cast("long")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# Keyed writes ------------------------------------------------------------

_CUST = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


# The table written to is all customers; the batch is made of all rows as well, two to a key; some keys are there and others new.
_ALL = f"new AS (SELECT c_custkey // 2 * 3 AS c_custkey, c_name, c_nationkey, round(c_acctbal + 1, 2) AS c_acctbal, c_mktsegment FROM customer), old AS (SELECT {', '.join(_CUST)} FROM customer)"


def _old_new(spark, sf_dir):
    c = D.read(spark, sf_dir, "customer").select(*_CUST)
    return c, c.withColumns({"c_custkey": F.expr("c_custkey div 2 * 3"), "c_acctbal": near(F.col("c_acctbal") + 1, 2)})


@query(f"WITH {_ALL}, batch AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY c_name DESC) = 1) SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM batch) UNION ALL SELECT * FROM batch")
def upsert_replace(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return sinks.replace(old, new, ["c_custkey"], [F.col("c_name")])


@query(f"WITH {_ALL}, batch AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY c_name) = 1) SELECT * FROM old UNION ALL SELECT * FROM batch WHERE c_custkey NOT IN (SELECT c_custkey FROM old)")
def upsert_ignore(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return sinks.ignore(old, new, ["c_custkey"], [F.col("c_name")])


@query(
    f"""WITH {_ALL}, batch AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY c_name DESC) = 1)
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN n.c_name ELSE o.c_name END AS c_name, CASE WHEN o.c_custkey IS NULL THEN n.c_nationkey ELSE o.c_nationkey END AS c_nationkey,
    CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal, CASE WHEN o.c_custkey IS NULL THEN n.c_mktsegment ELSE o.c_mktsegment END AS c_mktsegment FROM old o FULL JOIN batch n ON o.c_custkey = n.c_custkey"""
)
def upsert_update(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return sinks.update(old, new, ["c_custkey"], ["c_acctbal"], [F.col("c_name")])


@query(f"WITH {_ALL} SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)")
def delete_keys(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return sinks.delete(old, new.select("c_custkey").distinct())
