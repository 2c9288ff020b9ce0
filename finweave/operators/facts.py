"""Company facts: nested JSON to rows, derived metrics, statements, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.functions import constants as K
from finweave.functions.num import div

ITEM = "struct<val:double,fy:int,fp:string,form:string,filed:string,accn:string,start:string,end:string>"
FACTS = f"struct<cik:string,entityName:string,facts:map<string,map<string,struct<units:map<string,array<{ITEM}>>>>>>"


def flatten(raw: DataFrame, column: str = "json", years: Sequence[int] | None = None, forms: Sequence[str] = K.FORMS) -> DataFrame:
    """One row per reported value of a known tag: metric, tag, unit, value and
    where it was filed; dates that do not parse are null; of rows that agree in
    metric, year and period the one filed last stays. Malformed JSON gives no rows."""
    f = raw.select(F.from_json(column, FACTS).alias("f")).select("f.cik", F.explode(F.col("f.facts")["us-gaap"]).alias("tag", "body"))
    names = F.create_map(*[x for m, t in K.FACT_TAGS.items() for x in (F.lit(t), F.lit(m))])
    f = f.select("cik", F.try_element_at(names, F.col("tag")).alias("metric"), "tag", F.explode("body.units").alias("unit", "items")).filter("metric is not null")
    f = f.select("cik", "metric", "tag", "unit", F.explode("items").alias("i")).filter(F.col("i.form").isin(*forms))
    if years is not None:
        f = f.filter(F.col("i.fy").isin(*years))
    day = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd")
    f = f.select("cik", "metric", "tag", "unit", F.col("i.val").alias("value"), F.col("i.fy").alias("fiscal_year"), F.col("i.fp").alias("fiscal_period"), F.col("i.form").alias("form"), day("i.filed").alias("filed"), F.col("i.accn").alias("accession"), day("i.start").alias("start_date"), day("i.end").alias("end_date"))
    by = Window.partitionBy("cik", "metric", "fiscal_year", "fiscal_period").orderBy(F.col("filed").desc_nulls_last(), F.col("end_date").desc_nulls_last(), F.col("unit"), F.col("accession").desc_nulls_last(), F.col("value").desc_nulls_last())
    return f.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def submissions(raw: DataFrame, column: str = "json") -> DataFrame:
    """Parallel arrays of recent filings to one row per filing, in order."""
    kind = "struct<cik:string,filings:struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>>>>"
    f = raw.select(F.from_json(column, kind).alias("f")).select("f.cik", "f.filings.recent.*")
    z = f.select("cik", F.posexplode(F.arrays_zip("accessionNumber", "form", "filingDate")).alias("position", "x"))
    return z.select("cik", "position", F.replace("x.accessionNumber", F.lit("-"), F.lit("")).alias("accession"), F.col("x.form").alias("form"), F.try_to_date("x.filingDate", "yyyy-MM-dd").alias("filing_date"))


def yearly_filing(filings: DataFrame, year: int, form: str = "10-K") -> DataFrame:
    """The first listed filing of a form in the year or the next."""
    by = Window.partitionBy("cik").orderBy("position")
    f = filings.filter((F.col("form") == form) & F.year("filing_date").isin(year, year + 1))
    return f.withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")


DERIVED = {
    "GrossProfitCalc": lambda c: c("Revenue") - c("CostOfRevenue"),
    "GrossMargin": lambda c: div(c("Revenue") - c("CostOfRevenue"), c("Revenue")),
    "OperatingMargin": lambda c: div(c("OperatingIncome"), c("Revenue")),
    "NetMargin": lambda c: div(c("NetIncome"), c("Revenue")),
    "WorkingCapitalCalc": lambda c: c("CurrentAssets") - c("CurrentLiabilities"),
    "CurrentRatio": lambda c: div(c("CurrentAssets"), c("CurrentLiabilities")),
    "ROA": lambda c: div(c("NetIncome"), c("Assets")),
    "ROE": lambda c: div(c("NetIncome"), c("Equity")),
    "DebtToEquity": lambda c: div(c("LongTermDebt"), c("Equity")),
}


def pivot_metrics(metrics: DataFrame, keys: Sequence[str], names: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Long to wide with a stated list of names; of several values of a cell
    the first by ``order`` (else the least)."""
    value = F.min_by("value", F.struct(*order)) if order else F.min("value")
    return metrics.groupBy(*keys).pivot("metric_name", list(names)).agg(value)


def derived(metrics: DataFrame, keys: Sequence[str] = ("ticker", "fiscal_year")) -> DataFrame:
    """Nine derived metrics in long form; those that lack an input are left out."""
    need = ("Revenue", "CostOfRevenue", "OperatingIncome", "NetIncome", "CurrentAssets", "CurrentLiabilities", "Assets", "Equity", "LongTermDebt")
    w = pivot_metrics(metrics.filter(F.col("metric_name").isin(*need)), keys, need)
    w = w.select(*keys, *[e(F.col).alias(n) for n, e in DERIVED.items()])
    return w.unpivot(list(keys), list(DERIVED), "metric_name", "value").filter("value is not null").withColumn("source", F.lit("calculated"))


def statement(metrics: DataFrame, kind: str, years: Sequence[int]) -> DataFrame:
    """Matrix of one statement (BS, IS, CF): metric rows, a column per year,
    base and derived metrics once each."""
    both = metrics.select("ticker", "fiscal_year", "metric_name", "value").unionByName(derived(metrics).drop("source"))
    rows = both.filter(F.col("metric_name").isin(*K.STATEMENTS[kind]))
    return rows.groupBy("ticker", "metric_name").pivot("fiscal_year", list(years)).agg(F.min("value")).withColumnsRenamed({str(y): f"fy{y}" for y in years})


def unit_multiplier(unit: Column) -> Column:
    return F.when(unit.contains("Millions"), 1e6).when(unit.contains("Thousands"), 1e3).when(unit.contains("Hundreds"), 100.0).otherwise(1.0)


def standardise(rows: DataFrame) -> DataFrame:
    """Values times the multiplier that their unit names."""
    return rows.withColumn("multiplier", unit_multiplier(F.col("unit"))).withColumn("standard_value", F.col("value") * F.col("multiplier"))


def metrics_per_year(metrics: DataFrame) -> DataFrame:
    return metrics.filter("value is not null").groupBy("ticker", "fiscal_year").agg(F.countDistinct("metric_name").alias("metrics"))


def missing(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric_name").agg((F.avg(F.col("value").isNull().cast("double")) * 100).alias("missing_percent"))


def outliers(metrics: DataFrame) -> DataFrame:
    """Values beyond 1.5 interquartile ranges, per metric with more than three."""
    q = metrics.filter("value is not null").groupBy("metric_name").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("value").alias("n")).filter("n > 3")
    q = q.select("metric_name", "n", (F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("lo"), (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("hi"))
    j = metrics.join(q, "metric_name").filter((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    return j.groupBy("metric_name", "n").agg(F.count(F.lit(1)).alias("outliers"))


def identity_breaks(metrics: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Years in which assets differ from liabilities plus equity by more than the tolerance."""
    w = pivot_metrics(metrics.filter(F.col("metric_name").isin("Assets", "Liabilities", "Equity")), ("ticker", "fiscal_year"), ("Assets", "Liabilities", "Equity"))
    gap = F.abs(F.col("Assets") - F.col("Liabilities") - F.col("Equity"))
    return w.withColumn("difference", gap).filter(gap > F.abs("Assets") * tolerance)


def peer_metrics(rows: DataFrame, ciks: Sequence[str], metrics: Sequence[str], year: int) -> DataFrame:
    """The last filed value of each company and metric in a year."""
    by = Window.partitionBy("cik", "metric").orderBy(F.col("filed").desc_nulls_last(), F.col("value"))
    return rows.filter(F.col("cik").isin(*ciks) & F.col("metric").isin(*metrics) & (F.col("fiscal_year") == year)).withColumn("n", F.row_number().over(by)).filter("n = 1").select("cik", "metric", "value", "fiscal_year")


def header(raw: DataFrame, column: str = "json") -> DataFrame:
    """Company and number of tags that a facts document holds."""
    f = raw.select(F.from_json(column, FACTS).alias("f")).filter("f.cik is not null")
    return f.select("f.cik", F.col("f.entityName").alias("entity_name"), F.size(F.col("f.facts")["us-gaap"]).alias("tags"))
