"""Financial ratios, their interpretation, growth and stored ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.functions import constants as K
from finweave.functions.num import Series, div, near, positive_div

METRIC_INPUTS = (
    "Revenue", "CostOfRevenue", "GrossProfit", "OperatingExpenses", "OperatingIncome", "InterestExpense", "IncomeTaxExpense", "NetIncome", "Assets",
    "CurrentAssets", "Cash", "AccountsReceivable", "Inventory", "PPE", "Liabilities", "CurrentLiabilities", "LongTermDebt", "Equity", "OperatingCashFlow",
    "CapEx", "FreeCashFlow", "AccountsPayable", "DaysInventory", "DaysReceivables", "DaysPayables", "DebtPayments", "TaxRate", "Depreciation", "Amortization", "EBITDA",
)


def with_inputs(stmt: DataFrame) -> DataFrame:
    """Metrics that the frame lacks, as nulls: the schema of results is static."""
    return stmt.withColumns({m: F.lit(None).cast("double") for m in METRIC_INPUTS if m not in stmt.columns})


def expressions() -> dict[str, Column]:
    """Every ratio as an expression; null where an input is missing or the
    denominator is not positive."""
    c = F.col
    gross = F.coalesce(c("GrossProfit"), c("Revenue") - c("CostOfRevenue"))
    ebitda = F.coalesce(c("EBITDA"), c("OperatingIncome") + c("Depreciation") + c("Amortization"))
    working = c("CurrentAssets") - c("CurrentLiabilities")
    inventory = positive_div("CostOfRevenue", "Inventory")
    receivables = positive_div("Revenue", "AccountsReceivable")
    payables = positive_div("CostOfRevenue", "AccountsPayable")
    roic = c("OperatingIncome") * (1 - F.coalesce(c("TaxRate"), F.lit(0.21)))
    return {
        "current_ratio": positive_div("CurrentAssets", "CurrentLiabilities"),
        "quick_ratio": positive_div(c("CurrentAssets") - c("Inventory"), "CurrentLiabilities"),
        "cash_ratio": positive_div("Cash", "CurrentLiabilities"),
        "operating_cash_ratio": positive_div("OperatingCashFlow", "CurrentLiabilities"),
        "cash_conversion_cycle": F.when(c("CurrentLiabilities") > 0, c("DaysInventory") + c("DaysReceivables") - c("DaysPayables")),
        "debt_to_equity": positive_div("LongTermDebt", "Equity"),
        "debt_to_assets": positive_div("Liabilities", "Assets"),
        "equity_ratio": positive_div("Equity", "Assets"),
        "interest_coverage": positive_div("OperatingIncome", "InterestExpense"),
        "debt_service_coverage": positive_div("OperatingCashFlow", c("InterestExpense") + F.coalesce(c("DebtPayments"), F.lit(0.0))),
        "gross_margin": positive_div(gross, "Revenue"),
        "operating_margin": positive_div("OperatingIncome", "Revenue"),
        "net_margin": positive_div("NetIncome", "Revenue"),
        "ebitda_margin": positive_div(ebitda, "Revenue"),
        "roa": positive_div("NetIncome", "Assets"),
        "roe": positive_div("NetIncome", "Equity"),
        "roic": F.when(c("IncomeTaxExpense").isNotNull(), positive_div(roic, c("Equity") + c("LongTermDebt"))),
        "asset_turnover": positive_div("Revenue", "Assets"),
        "fixed_asset_turnover": positive_div("Revenue", "PPE"),
        "working_capital_turnover": positive_div("Revenue", working),
        "inventory_turnover": inventory,
        "receivables_turnover": receivables,
        "payables_turnover": payables,
        "days_inventory": div(365.0, inventory),
        "days_receivables": div(365.0, receivables),
        "days_payables": div(365.0, payables),
    }


CATEGORY = {r: c for c, names in K.RATIO_CATEGORIES.items() for r in names}


def wide(stmt: DataFrame) -> DataFrame:
    """ticker, fiscal_year and every ratio."""
    return with_inputs(stmt).select("ticker", "fiscal_year", *[e.alias(n) for n, e in expressions().items()])


def interpretation(name: Column, value: Column) -> Column:
    out = F.lit(K.NORMAL_RANGE)
    for ratio, bands in K.INTERPRETATIONS.items():
        for lo, hi, text in bands:
            inside = (value >= lo) if lo is not None else F.lit(True)
            inside = inside & (value < hi) if hi is not None else inside
            out = F.when((name == ratio) & inside, text).otherwise(out)
    return out


def health(name: Column, value: Column) -> Column:
    """0..100: 100 at the ideal or better; unknown ratios 50."""
    out = F.lit(50.0)
    for ratio, ideal in K.IDEALS.items():
        if ratio == "debt_to_equity":
            s = F.when(value <= ideal, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - 50 * (value - ideal) / ideal))
        else:
            s = F.when(value >= ideal, F.least(F.lit(100.0), 50 + 50 * value / ideal)).otherwise(F.greatest(F.lit(0.0), 50 * value / ideal))
        out = F.when(name == ratio, s).otherwise(out)
    return near(out, 1)


def all_ratios(stmt: DataFrame, industry: str = "Technology") -> DataFrame:
    """One row per ratio that can be computed: category, value, what it means,
    health score and the industry's benchmark."""
    rows = wide(stmt).unpivot(["ticker", "fiscal_year"], list(expressions()), "ratio_name", "value").filter("value is not null")
    name, value = F.col("ratio_name"), F.col("value")
    marks = K.INDUSTRY_BENCHMARKS.get(industry, K.INDUSTRY_BENCHMARKS["Technology"])
    pick = lambda m: reduce(lambda acc, kv: F.when(name == kv[0], F.lit(kv[1])).otherwise(acc), m.items(), F.lit(None))
    return rows.select(
        "ticker",
        "fiscal_year",
        F.lit("FY").alias("fiscal_period"),
        pick(CATEGORY).alias("category"),
        "ratio_name",
        "value",
        interpretation(name, value).alias("interpretation"),
        health(name, value).alias("health_score"),
        pick(marks).cast("double").alias("benchmark"),
    )


def report(ratios: DataFrame) -> DataFrame:
    """Display names and rounded values, by category and name."""
    return ratios.select("ticker", "fiscal_year", "category", F.initcap(F.replace("ratio_name", F.lit("_"), F.lit(" "))).alias("ratio"), near("value", 3).alias("value"), "interpretation", "health_score").orderBy("ticker", "fiscal_year", "category", "ratio")


def growth(stmt: DataFrame) -> DataFrame:
    """(current - prior) / prior for prior > 0, against the year before."""
    s = Series(("ticker",), ("fiscal_year",))
    pairs = {"revenue_growth": "Revenue", "earnings_growth": "NetIncome", "asset_growth": "Assets", "operating_cash_flow_growth": "OperatingCashFlow"}
    before = s.lag("fiscal_year") == F.col("fiscal_year") - 1
    return stmt.select("ticker", "fiscal_year", *[F.when(before & (s.lag(m) > 0), (F.col(m) - s.lag(m)) / s.lag(m)).alias(n) for n, m in pairs.items()])


def stored(stmt: DataFrame) -> DataFrame:
    """The fifteen ratios of the ratio table: plain quotients, null only at 0,
    day counts guarded; the cash cycle is inventory plus receivable days."""
    c = F.col
    di = F.when(c("CostOfRevenue") > 0, div(c("Inventory") * 365, "CostOfRevenue"))
    dr = F.when(c("Revenue") > 0, div(c("AccountsReceivable") * 365, "Revenue"))
    out = {
        "current_ratio": div("CurrentAssets", "CurrentLiabilities"),
        "quick_ratio": div(c("CurrentAssets") - c("Inventory"), "CurrentLiabilities"),
        "cash_ratio": div("Cash", "CurrentLiabilities"),
        "debt_to_equity": div("LongTermDebt", "Equity"),
        "debt_to_assets": div("Liabilities", "Assets"),
        "gross_margin": div("GrossProfit", "Revenue"),
        "operating_margin": div("OperatingIncome", "Revenue"),
        "net_margin": div("NetIncome", "Revenue"),
        "roa": div("NetIncome", "Assets"),
        "roe": div("NetIncome", "Equity"),
        "asset_turnover": div("Revenue", "Assets"),
        "inventory_turnover": F.when(c("Inventory") > 0, div("CostOfRevenue", "Inventory")),
        "days_inventory": di,
        "days_receivables": dr,
        "cash_conversion_cycle": di + dr,
    }
    return with_inputs(stmt).select("ticker", "fiscal_year", *[e.alias(n) for n, e in out.items()])


def trends(stored_ratios: DataFrame) -> DataFrame:
    """Three ratios beside those of the year before."""
    s = Series(("ticker",), ("fiscal_year",))
    return stored_ratios.select("ticker", "fiscal_year", *[x for r in ("current_ratio", "gross_margin", "roe") for x in (F.col(r), s.lag(r).alias(f"prior_{r}"))])


def yoy(metrics: DataFrame, keep_first_year: bool = False) -> DataFrame:
    """Each metric beside the year before: absolute and percent change. One
    row per ticker, metric and year is expected, so the year before is the row
    before if its year says so: a window computes the metrics once, where a
    self-join would twice."""
    s = Series(("ticker", "metric_name"), ("fiscal_year",))
    prior = F.when(s.lag("fiscal_year") == F.col("fiscal_year") - 1, s.lag("value"))
    there = s.lag("fiscal_year") == F.col("fiscal_year") - 1
    j = metrics.select("ticker", "fiscal_year", "metric_name", F.col("value").alias("current_value"), prior.alias("prior_value"), F.coalesce(there, F.lit(False)).alias("__there"))
    j = j if keep_first_year else j.filter("__there")
    change = F.col("current_value") - F.col("prior_value")
    return j.select("ticker", "fiscal_year", "metric_name", "current_value", "prior_value", change.alias("absolute_change"), (div(change, "prior_value") * 100).alias("percent_change"))
