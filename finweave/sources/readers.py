"""Readers of landed files. Fetching is a step before the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILING = "cik string, ticker string, year int, filing_date string, accession_number string, form string, content struct<full_text:string,html_sections:map<string,string>,exhibits:array<string>>"


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """Ticker map as landed (object of objects): upper-case ticker, padded cik;
    of repeats the last key wins."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<cik_str:string,ticker:string,title:string>>")).alias("k", "c"))
    rows = raw.select(F.col("k").cast("int").alias("k"), F.upper("c.ticker").alias("ticker"), F.lpad("c.cik_str", 10, "0").alias("cik"), F.col("c.title").alias("name"))
    return rows.groupBy("ticker").agg(F.max_by("cik", "k").alias("cik"), F.max_by("name", "k").alias("name"))


def with_cik(rows: DataFrame, map_: DataFrame) -> DataFrame:
    """Adds cik by upper-case ticker; null if unknown."""
    m = map_.select(F.col("ticker").alias("__t"), "cik")
    return rows.join(m, F.upper("ticker") == F.col("__t"), "left").drop("__t")


def filings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILING).json(path, multiLine=True)


def wanted_filings(tickers_: DataFrame, years: list[int]) -> DataFrame:
    """Every ticker with every year."""
    return tickers_.select("ticker", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))


def facts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, as text in column json."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def price_files(spark: SparkSession, path: str) -> DataFrame:
    """Bars from Parquet with names in lower snake case."""
    df = spark.read.parquet(path)
    return df.withColumnsRenamed({c: c.strip().lower().replace(" ", "_") for c in df.columns})


def sections(spark: SparkSession, path: str) -> DataFrame:
    """Processed filings, a map of section to text per file, in file-name
    order; files that are no JSON map are skipped."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    return raw.filter("m is not null").select("file", F.explode("m").alias("section", "text")).orderBy("file", "section")


def filing_url_id(accession: Column) -> Column:
    """Accession number as 10-2-6 digits."""
    a = F.replace(accession, F.lit("-"), F.lit(""))
    return F.concat_ws("-", F.substring(a, 1, 10), F.substring(a, 11, 2), F.substring(a, 13, 6))
