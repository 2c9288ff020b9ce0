"""Domain frames on the driver's tables: price bars, statements, companies,
macro series. Each is an aggregate of bounded size per key, made with one
exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.functions.num import near

#: Metrics of a statement as (name, expression over the yearly sums).
STATEMENT = (
    ("Revenue", "rev"),
    ("CostOfRevenue", "qty * 800"),
    ("GrossProfit", "rev - qty * 800"),
    ("OperatingExpenses", "n * 3000"),
    ("OperatingIncome", "rev - qty * 800 - n * 3000"),
    ("InterestExpense", "tax * 0.1"),
    ("IncomeTaxExpense", "tax * 0.5"),
    ("NetIncome", "rev - qty * 800 - n * 3000 - tax * 0.6"),
    ("Assets", "gross * 1.5"),
    ("CurrentAssets", "qty * 700"),
    ("Cash", "qty * 200"),
    ("AccountsReceivable", "qty * 150"),
    ("Inventory", "disc * 2"),
    ("PPE", "gross * 0.5"),
    ("Liabilities", "gross * 0.9"),
    ("CurrentLiabilities", "n * 9000"),
    ("LongTermDebt", "gross * 0.3"),
    ("Equity", "gross * 0.6"),
    ("OperatingCashFlow", "rev * 0.25"),
    ("CapEx", "tax"),
    ("FreeCashFlow", "rev * 0.25 - tax"),
)
METRICS = tuple(m for m, _ in STATEMENT)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, open, high, low, close, volume: orders by priority and day."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker (nation), fiscal_year and one column per metric."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fiscal_year"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    who = o.join(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "fiscal_year", "ticker")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    units = lambda x, k: (F.sum(F.round(x * k).cast("long")) / F.lit(float(k)))  # noqa: E731  whole units add up exactly, in any order
    sums = li.join(who, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("ticker", "fiscal_year").agg(
        units(net, 10_000).alias("rev"),
        units(F.col("l_extendedprice"), 100).alias("gross"),
        units(F.col("l_extendedprice") * F.col("l_discount"), 10_000).alias("disc"),
        units(net * F.col("l_tax"), 1_000_000).alias("tax"),
        units(F.col("l_quantity"), 100).alias("qty"),
        F.count(F.lit(1)).alias("n"),
    )
    return sums.select("ticker", "fiscal_year", *[F.expr(e).cast("double").alias(m) for m, e in STATEMENT])


def metric_rows(stmt: DataFrame, metrics: tuple[str, ...] = METRICS, name: str = "metric_name") -> DataFrame:
    """ticker, fiscal_year, metric name, value: nulls kept."""
    return stmt.unpivot(["ticker", "fiscal_year"], list(metrics), name, "value")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    where = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(where, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"),
        F.col("s_name").alias("ticker"),
        F.col("s_name").alias("name"),
        F.col("r_name").alias("sector"),
        F.col("n_name").alias("industry"),
        F.abs("s_acctbal").alias("market_cap"),
        F.lpad((F.col("n_nationkey") + 7300).cast("string"), 4, "0").alias("sic_code"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, date, value: events by type and day."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("date")).agg(near(F.avg("value"), 4).alias("value"))


# The same frames for the DuckDB side.
_BASE = ", ".join(f"CAST({e} AS DOUBLE) AS {m}" for m, e in STATEMENT)
SQL = {
    "bars": """bars AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open,
        max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2)""",
    "stmt": f"""sums AS (SELECT n_name AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) / 10000.0::DOUBLE AS rev,
        sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE AS gross, sum(CAST(round(l_extendedprice * l_discount * 10000) AS BIGINT)) / 10000.0::DOUBLE AS disc, sum(CAST(round(l_extendedprice * (1 - l_discount) * l_tax * 1000000) AS BIGINT)) / 1000000.0::DOUBLE AS tax,
        sum(CAST(round(l_quantity * 100) AS BIGINT)) / 100.0::DOUBLE AS qty, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), stmt AS (SELECT ticker, fiscal_year, {_BASE} FROM sums)""",
    "long": f"long AS (UNPIVOT (SELECT * FROM stmt) ON {', '.join(METRICS)} INTO NAME metric_name VALUE value)",
    "companies": """companies AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS ticker, s_name AS name, r_name AS sector, n_name AS industry,
        abs(s_acctbal) AS market_cap, lpad(CAST(n_nationkey + 7300 AS VARCHAR), 4, '0') AS sic_code
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "macro": "macro AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS date, round(avg(value), 4) AS value FROM events GROUP BY 1, 2)",
}


def sql(*names: str) -> str:
    """WITH and the named frames; further ones may follow after a comma."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
